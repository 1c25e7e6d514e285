"""Ranks, and the constants and weights of BM25, that searches of texts and of the index share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def ranked(scored: DataFrame, k: int | None, key: str, by: str = "query_id", score: str = "score") -> DataFrame:
    """``scored`` with rank: best first, ties by key; the first k."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)))
    return out if k is None else out.where(F.col("rank") <= k)


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))
