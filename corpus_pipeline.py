"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, mixing.

run(spark, sf_dir) applies STAGES in order to the documents; each stage reads, as Parquet from the shared folder, what the
stage before has kept. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import durable, free, table
from quernstone.llm.decontaminate import clean
from quernstone.llm.mixing import mix
from quernstone.llm.near_copies import near_copies, row_key
from quernstone.llm.pii import annotate
from quernstone.llm.quality import quality


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Those without doc_id can't be looked up and stay; rows that share a doc_id stay if one of them is kept; null and empty texts are scored
    like any other; without labels of both kinds all stay; an empty table gives none. Names of other columns can't clash with helpers.
    """
    scored = quality(docs, table(spark, sf_dir, "labels"))
    # rows that share a doc_id go together, by the best of them
    out = free(docs, "bad_id")
    bad = durable(scored.where("doc_id is not null").groupBy(F.col("doc_id").alias(out)).agg(F.max("predicted").alias("best")).where("best = 0").select(out))
    return docs.join(bad, docs["doc_id"] == bad[out], "left_anti")


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of SimHash near-duplicates, verified at 0.8 of the shingles of five words, see near_copies.

    Texts without words, null ones among them, are one group; of rows alike in doc_id and text one stays; rows of one doc_id with different
    texts are judged apart; documents without doc_id stay; an empty table gives none. Names of other columns can't clash with helpers.
    """
    groups = near_copies(docs)
    # rows of one doc_id with different texts are judged apart
    near_id, near_k, own_k = free(docs, "near_id"), free(docs, "near_k"), free(docs, "own_k")
    first = durable(groups.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("e")).select(F.col("e.doc_id").alias(near_id), F.col("e.k").alias(near_k)))
    # one exchange of the texts at every size; rows that repeat a doc_id and text lie side by side after it, and one stays
    known = docs.where("doc_id is not null").withColumn(own_k, row_key())
    same = (F.col("doc_id") == F.col(near_id)) & (F.col(own_k) == F.col(near_k))
    kept = known.join(first.hint("merge"), same).drop(near_id, near_k).dropDuplicates(["doc_id", own_k]).drop(own_k)
    return kept.unionByName(docs.where("doc_id is null"))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; documents without doc_id are judged like others; rows alike are judged alike, and those that share a
    doc_id by their own texts; without items all stay; an empty table gives none. Names of other columns can't clash with helpers.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with [KIND] for each piece of personal data, and n_chars of the new text.

    Null texts stay null, and so does their n_chars; every row is kept, repeated ones and those without doc_id too; long texts are
    read whole; an empty table gives none. A column named pii, in any case of letters, keeps its name and content.
    """
    hidden = annotate(docs, redact=True)
    return hidden.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, size, source_size, target and taken words (repeats counted) of documents with any.

    Null and empty texts have size 0 and aren't taken; a null source is one of its own; rows alike are interchangeable; an empty table gives
    none. Other columns aren't read, so their names can't clash.
    """
    return mix(docs).where("taken > 0")


STAGES = [
    ("quality", good),
    ("near_duplicates", single),
    ("decontamination", unseen),
    ("personal_data", private),
    ("mixing", mixed),
]

#: A trained classifier and trained spans are beyond SQL; tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
