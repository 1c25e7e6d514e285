"""Where results go: a content-addressed store, tagged export, reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: the session's spark.checkpoint.dir; a temporary one only where all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: what a plan uses several times is computed once."""
    path = f"{shared_dir(df.sparkSession)}/quernstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(files: DataFrame, path: str) -> DataFrame:
    """Writes contents (content) under their SHA-256, once each, partitioned by its first two digits; returns what was new."""
    spark = files.sparkSession
    rows = files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    try:
        known = spark.read.parquet(path).select("sha256")
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        fresh = rows
    else:
        fresh = rows.join(known, "sha256", "left_anti")
    fresh.write.mode("append").partitionBy("shard").parquet(path)
    return fresh.select("sha256")


def tagged(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """type, id, value: rows of all tables (name: table and its key) as JSON lines, ordered by type and id."""
    out = None
    for name, (df, key) in tables.items():
        line = F.to_json(F.struct(F.lit(name).alias("type"), F.struct(*sorted(df.columns)).alias("data")), {"ignoreNullFields": "false"})
        one = df.select(F.lit(name).alias("type"), F.col(key).cast("string").alias("id"), line.alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("type", "id")


def export(tables: Mapping[str, tuple[DataFrame, str]], path: str) -> None:
    tagged(tables).select("value").write.mode("overwrite").text(path)


def report(metrics: DataFrame, path: str, most: int = 1000) -> str:
    """Writes a table as JSON, and returns it as Markdown; one of more than ``most`` rows is written, but is no report."""
    metrics.write.mode("overwrite").json(path)
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
