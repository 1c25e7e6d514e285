"""What the training-data operators share: durable tables, table loading and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every word count and shingle here: space and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: the session's spark.checkpoint.dir, or one of our own where that is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores as many as it takes to be no column of ``df`` in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quernstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs); root is the smallest node reachable.

    Large-star and small-star rounds. Each round sends an edge to the smallest neighbour of one of its ends,
    found by a partially aggregated minimum; a node with very many edges meets its minimum in a sort-merge join
    whose large partitions adaptive execution splits. No node's neighbours are ever gathered.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return durable(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())

    # u is the larger end from here on
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both)
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # of a node that is smaller than all its neighbours m is the node itself: its edges stay
        large = durable(large.where("u <> v").distinct())
        m = smallest(large)
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = durable(small.select(F.greatest("e.a", "e.b").alias("u"), F.least("e.a", "e.b").alias("v")).where("u <> v").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hex64(c: Column) -> Column:
    """A long as 16 lower-case hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
