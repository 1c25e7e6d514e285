"""Streams of connector events and of file scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, at: str = "ts", delay: str = "1 hour", *key: str) -> DataFrame:
    """Each event once, by its key (or all that it holds), within a watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark(list(key) or [c for c in events.columns if c != at])


def sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """by, start, end, n: sessions, given out once the watermark has passed them. An extension."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    w = timed.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, by: str, at: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """by, start, n: tumbling or sliding windows with late data up to ``delay``. An extension."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    w = timed.groupBy(by, F.window(at, size, slide or size).alias("w")).agg(F.count("*").alias("n"))
    return w.select(by, F.col("w.start").alias("start"), "n")


def folding(path: str, key: str, at: str, tie: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each batch's last event of a key; a batch that runs again overwrites its own folder."""

    def fold(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(at, tie)).alias("v")).select("v.*")
        last.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return fold


def folded(path_rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key over all batches that ``folding`` has written."""
    columns = [c for c in path_rows.columns if c != "epoch"]
    return path_rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("v")).select("v.*")


def absences(seen: DataFrame, grace: int = 2) -> DataFrame:
    """path, scan_id, absences, is_deleted after each complete scan, for a stream of (path, scan_id, present).

    A path's state is how many complete scans in a row have missed it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed = state.get[0] if state.exists else 0
        rows = []
        for scan_id, present in sorted(x for f in frames for x in zip(f["scan_id"], f["present"], strict=True)):
            missed = 0 if present else missed + 1
            rows.append((key[0], int(scan_id), int(missed), missed >= grace))
        state.update((int(missed),))
        yield pd.DataFrame(rows, columns=["path", "scan_id", "absences", "is_deleted"])

    return seen.groupBy("path").applyInPandasWithState(step, "path string, scan_id long, absences long, is_deleted boolean", "missed long", "append", GroupStateTimeout.NoTimeout)
