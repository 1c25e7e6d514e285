"""The query of each training-data operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.codes import ORACLE as CODES_SQL
from quernstone.llm.codes import codes
from quernstone.llm.common import table
from quernstone.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from quernstone.llm.decontaminate import report
from quernstone.llm.language import languages
from quernstone.llm.minhash import ORACLE as MINHASH_SQL
from quernstone.llm.minhash import near_duplicates
from quernstone.llm.mixing import ORACLE as MIX_SQL
from quernstone.llm.mixing import mix
from quernstone.llm.passages import passages
from quernstone.llm.pii import digest
from quernstone.llm.quality import quality
from quernstone.llm.repeats import ORACLE as REPEATS_SQL
from quernstone.llm.repeats import cut
from quernstone.llm.resample import ORACLE as RESAMPLE_SQL
from quernstone.llm.resample import resample
from quernstone.llm.simhash import simhash
from quernstone.llm.topk import ORACLE as TOPK_SQL
from quernstone.llm.topk import topk
from quernstone.llm.toxicity import toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents")).drop("kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_topk": op4_topk,
    "op5_toxicity": op5_toxicity,
    "op6_passages": op6_passages,
    "op7_repeats": op7_repeats,
    "op8_language": op8_language,
    "op9_pii": op9_pii,
    "op10_mix": op10_mix,
    "op11_codes": op11_codes,
    "op12_minhash": op12_minhash,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": DECONTAMINATE_SQL,
    "op4_topk": TOPK_SQL,
    "op7_repeats": REPEATS_SQL,
    "op10_mix": MIX_SQL,
    "op11_codes": CODES_SQL,
    "op12_minhash": MINHASH_SQL,
    "op13_resample": RESAMPLE_SQL,
}
