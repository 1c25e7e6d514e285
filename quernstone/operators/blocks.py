"""A stated set of queries against all rows, in one pass or in blocks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that are broadcast at most.
BOUND = 10_000


def meet(rows: DataFrame, queries: DataFrame, key: str, on: Column) -> DataFrame:
    """Pairs of a row and a query for which ``on`` holds.

    A set of BOUND queries or fewer is counted and broadcast. A larger one goes once to each block of rows: blocks are by hash of the
    key, as many as shuffle partitions, so that no task holds more than its block and no row moves twice.
    """
    if queries.limit(BOUND + 1).count() <= BOUND:
        return rows.join(F.broadcast(queries), on)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    copies = queries.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.join(copies, (F.col("_block") == F.col("_copy")) & on).drop("_block", "_copy")
