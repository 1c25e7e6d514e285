"""Registration of queries with the SQL that they are held against, and the model's tables over the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.postings import Index, build
from quernstone.sources.sinks import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Scopes of the context that the queries run in.
CONTEXT = ("lang:en", "lang:de", "tier:0", "tier:1")


def query(sql: str | None = None):
    """Registers a function of a session and a folder under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content units of the documents: a hundred documents of many units each, scopes by language and tier."""
    d = table(spark, sf_dir, "documents")
    scopes = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("tier:"), (F.col("doc_id") % 3).cast("string"))))
    return d.select(F.col("doc_id").alias("unit_id"), (F.col("doc_id") % 100).alias("document_id"), F.col("text").alias("body"), "source", "lang", scopes.alias("acl_scopes"))


UNITS = """u AS (SELECT doc_id AS unit_id, doc_id % 100 AS document_id, text AS body, source, lang,
  CASE WHEN doc_id % 10 = 0 THEN []::VARCHAR[] ELSE ['lang:' || lang, 'tier:' || (doc_id % 3)] END AS acl_scopes FROM documents)"""
SEEN = UNITS + """, seen AS (SELECT * FROM u WHERE len(list_filter(acl_scopes, lambda s: NOT list_contains(['lang:en', 'lang:de', 'tier:0', 'tier:1'], s))) = 0)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark item: all of it."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query"))


ASKED = r"""q AS (SELECT item_id AS query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM benchmark)"""

#: Indexes that this process has built, by application, tables and what they are of: built once, then searched.
INDEXES: dict[tuple[str, str, str, str], Any] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` builds, once for the tables as they are now."""
    known = (spark.sparkContext.applicationId, sf_dir, ",".join(sorted(table(spark, sf_dir, "documents").inputFiles())), name)
    if known not in INDEXES:
        INDEXES[known] = make()
    return INDEXES[known]


def lexicon(spark: SparkSession, sf_dir: str, of: DataFrame, name: str) -> Index:
    """The stored BM25 index of units ``of``."""
    root = f"{shared_dir(spark)}/quernstone-index-{uuid.uuid4().hex}"
    return stored(spark, sf_dir, f"lexicon {name}", lambda: build(Index(spark, root, T.bm25_tokens), of))
