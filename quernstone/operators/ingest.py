"""Revisions and projections: what is current, what has changed, what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order given."""
    own = [by] if isinstance(by, str) else by
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where("_n = 1").drop("_n")


def latest(rows: DataFrame, by: str, at: str, tie: str, *values: str) -> DataFrame:
    """The newest values of each key, by partial aggregation: a key with very many rows never meets in one task."""
    best = F.max_by(F.struct(*values), F.struct(at, tie))
    return rows.groupBy(by).agg(best.alias("_v")).select(by, "_v.*")


def is_latest(revisions: DataFrame, document: str = "document_id", modified: str = "modified_at") -> DataFrame:
    """``revisions`` with is_latest: as new as any of its document; unknown times count as latest."""
    top = revisions.groupBy(document).agg(F.max(modified).alias("_top"))
    return revisions.join(top, document).withColumn("is_latest", F.coalesce(F.col(modified) >= F.col("_top"), F.lit(True))).drop("_top")


def rebuild_diff(projected: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """One row: deleted, changed (new ones included) and total of a projection rebuilt from ``wanted``."""
    p, w = projected.select(key, F.col(value).alias("_p"), F.lit(True).alias("_in_p")), wanted.select(key, F.col(value).alias("_w"), F.lit(True).alias("_in_w"))
    both = p.join(w, key, "full")
    changed = F.col("_in_w").isNotNull() & (F.col("_in_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_w")))
    return both.agg(F.count_if(F.col("_in_w").isNull()).alias("deleted"), F.count_if(changed).alias("changed"), F.count_if(F.col("_in_w").isNotNull()).alias("total"))


def changed_files(scan: DataFrame, state: DataFrame) -> DataFrame:
    """path, change: of files (path, size, mtime_ns, sha256) against the state; size and time alike means unchanged."""
    s = state.select("path", *[F.col(x).alias(f"_{x}") for x in ("size", "mtime_ns", "sha256")])
    kind = (
        F.when(F.col("_size").isNull(), "inserted")
        .when((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime_ns")), "unchanged")
        .when(F.col("sha256") == F.col("_sha256"), "touched")
        .otherwise("replaced")
    )
    return scan.join(s, "path", "left").select("path", kind.alias("change"))


def deletion_grace(scans: DataFrame, seen: DataFrame, grace: int = 2) -> DataFrame:
    """path, absences, is_deleted after the last scan; scans: (scan_id, complete), seen: (scan_id, path), skipped ones included.

    Absences are complete scans since a path was last seen; scans that saw nothing, or that broke off, don't count, though
    what they saw does. One path's own last scan and one list of scan counts are enough: no window over scans times paths.
    """
    sizes = seen.groupBy("scan_id").agg(F.count("*").alias("n"))
    counted = scans.join(sizes, "scan_id", "left").withColumn("counts", (F.col("complete") & (F.coalesce("n", F.lit(0)) > 0)).cast("int"))
    # a row for each scan
    running = counted.withColumn("upto", F.sum("counts").over(Window.orderBy("scan_id").rowsBetween(Window.unboundedPreceding, 0)))
    total = running.agg(F.max("upto").alias("total"))
    last = seen.groupBy("path").agg(F.max("scan_id").alias("scan_id"))
    out = last.join(running.select("scan_id", "upto"), "scan_id").crossJoin(F.broadcast(total)).withColumn("absences", F.col("total") - F.col("upto"))
    return out.select("path", F.col("absences").cast("long").alias("absences"), (F.col("absences") >= grace).alias("is_deleted"))


def folded_events(events: DataFrame, key: str, at: str, tie: str, payload: str, operation: str) -> DataFrame:
    """key, payload, is_deleted, n_versions: the last of each key's events; equal payloads in a row of versions count once."""
    out = events.groupBy(key).agg(
        F.max_by(F.struct(payload, operation), F.struct(at, tie)).alias("_v"),
        F.countDistinct(F.xxhash64(F.coalesce(payload, F.lit("")), operation)).alias("n_versions"),
    )
    return out.select(key, F.col(f"_v.{payload}").alias("payload"), (F.col(f"_v.{operation}") == "delete").alias("is_deleted"), "n_versions")


def thread_fold(messages: DataFrame, thread: str, turn: str, role: str, text: str) -> DataFrame:
    """thread, n_messages, body: [role] text by turn, with blank lines between."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, role, text)))
    body = F.array_join(F.transform("_m", lambda m: F.concat(F.lit("["), m[role], F.lit("] "), m[text])), "\n\n")
    return messages.groupBy(thread).agg(ordered.alias("_m")).select(thread, F.size("_m").cast("long").alias("n_messages"), body.alias("body"))


def identifier_text(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def ordered_lookup(ids: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """``units`` in the order asked for: ids (position, key); raises on demand by ``missing``."""
    return ids.join(units, key)


def missing(ids: DataFrame, units: DataFrame, key: str) -> DataFrame:
    return ids.join(units, key, "left_anti")


def retained(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(at) >= cutoff)
