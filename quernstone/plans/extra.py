"""Queries that SQL can't express: normal forms, fuzzy ranks, chunks, streams. Tests hold them against plain versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import fuzzy
from quernstone.functions import text as T
from quernstone.operators import lexical
from quernstone.plans.registry import asked, query, table, units
from quernstone.sources import parsers, sinks
from quernstone.streaming import events, jobs


#: Commands in a batch of the job queue, about.
COMMANDS = 1_000_000


@query()
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize_text("text").alias("text"), T.normalize_name("text").alias("name"))


@query()
def fuzzy_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir)
    hits = lexical.bm25(units(spark, sf_dir), q, 10).join(units(spark, sf_dir).select("unit_id", F.col("body").alias("document")), "unit_id")
    return fuzzy.fuzzy_rerank(hits.select("query_id", (F.col("rank") - 1).alias("index"), "document"), q)


@query()
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 4000 characters with an overlap of 400."""

    return parsers.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a stream gives them out, to a table; a last event of no user, a year on, closes those that are open. An extension."""
    path = f"{sinks.shared_dir(spark)}/quernstone-sessions-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    e.write.parquet(f"{path}/events")
    source = spark.readStream.schema(e.schema).parquet(f"{path}/events")
    q = events.sessions(source, "user_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    q.processAllAvailable()
    end = e.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts")
    end.write.mode("append").parquet(f"{path}/events")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{path}/out").where("user_id is not null").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def live_job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workspace, job, status, attempts, worker: where jobs stand once the events have gone through a queue in a stream's state as commands."""
    path, k, kind = f"{sinks.shared_dir(spark)}/quernstone-jobs-{uuid.uuid4().hex}", F.col("event_id"), F.col("event_type")
    op = F.when(kind == "view", "enqueue").when(kind == "error", "fail").when(kind == "purchase", "complete").otherwise("claim")
    job = F.concat(F.lit("job"), (F.col("user_id") % 97).cast("string"))
    commands = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ws"), (F.col("user_id") % 3).cast("string")).alias("workspace"), jobs.shard_of(job, 4).alias("shard"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"), op.alias("op"), job.alias("job"),
        F.lit("worker").alias("worker"), (k % 3).cast("int").alias("priority"), F.when(op == "complete", F.lit("{}")).otherwise(F.lit("text")).alias("payload"), F.lit(3).alias("max_attempts"),
    )
    # a file for each slice of time, one after another: a batch of the stream holds COMMANDS or so, and none of an earlier slice comes late
    second = F.unix_seconds("at")
    slices = -(-commands.count() // COMMANDS)
    bounds = commands.agg(F.percentile_approx(second, [n / slices for n in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    place = sum((F.when(second >= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    commands.withColumn("slice", place).write.partitionBy("slice").parquet(f"{path}/slices")
    for n in range(len(set(bounds)) + 1):
        spark.read.parquet(f"{path}/slices").where(F.col("slice") == n).select(commands.columns).coalesce(1).write.mode("append").parquet(f"{path}/in")
    usual = spark.conf.get(jobs.STORE)
    jobs.with_state_store(spark)
    try:
        changes = jobs.queue(spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        # what is written again after a restart takes the place of its batch
        write = lambda df, n: df.withColumn("n", F.lit(n << 50) + F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(jobs.STORE, usual)
    return jobs.states(spark.read.parquet(f"{path}/out").drop("batch")).select("workspace", "job", "status", "attempts", "worker")
