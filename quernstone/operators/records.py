"""Views of stored records, their states, and measures of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.evaluate import precision_recall


def projection_status(progress: DataFrame) -> DataFrame:
    """``progress`` (enabled, dim, wanted_dim, active, total, done) with status."""
    status = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("dim").isNull(), "missing")
        .when(F.col("dim") != F.col("wanted_dim"), "incompatible")
        .when(~F.col("active"), "shadow")
        .when(F.col("done") < F.col("total"), "stale")
        .otherwise("active")
    )
    return progress.withColumn("status", status)


def freshness(evidence: DataFrame, scan: DataFrame) -> DataFrame:
    """path, fresh of evidence (path, size, mtime, sha256) against the files as they are: same time and size, or same content."""
    now = scan.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime", "sha256")])
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return evidence.join(now, "path", "left").select("path", F.coalesce(same | (F.col("sha256") == F.col("_sha256")), F.lit(False)).alias("fresh"))


def document_view(artifacts: DataFrame, bridge: DataFrame) -> DataFrame:
    """document_id, artifacts: the files of each document, primary ones first, then by name."""
    own = bridge.join(artifacts, "artifact_id")
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("later"), "file_name", "artifact_id")))
    return own.groupBy("document_id").agg(F.transform(ordered, lambda a: a["artifact_id"]).alias("artifacts"))


def review_list(candidates: DataFrame, names: DataFrame, evidence: DataFrame, units: DataFrame, width: int = 280) -> DataFrame:
    """id, subject, object, snippet of candidates (id, subject_id, object_id): names, and the start of the first piece of evidence."""
    first = evidence.groupBy("candidate_id").agg(F.min("unit_id").alias("unit_id")).join(units.select("unit_id", T.prefix_snippet("body", width).alias("snippet")), "unit_id")
    s, o = (names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c)) for c in ("subject", "object"))
    out = candidates.join(s, "subject_id", "left").join(o, "object_id", "left").join(first, F.col("id") == F.col("candidate_id"), "left")
    return out.select("id", F.coalesce("subject", "subject_id").alias("subject"), F.coalesce("object", "object_id").alias("object"), "snippet")


def explained(assertions: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, evidence_ids, origin of each assertion (id, source_candidate_id)."""
    own = evidence.groupBy(F.col("assertion_id").alias("id")).agg(F.array_sort(F.collect_set("unit_id")).alias("evidence_ids"))
    made = candidates.select(F.col("id").alias("source_candidate_id"), F.when(F.col("auto_approved"), "policy").otherwise("review").alias("origin"))
    none = F.array().cast("array<bigint>")
    return assertions.join(own, "id", "left").join(made, "source_candidate_id", "left").select("id", F.coalesce("evidence_ids", none).alias("evidence_ids"), F.coalesce("origin", F.lit("import")).alias("origin"))


def graph_metrics(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """kind, precision, recall, duplicates over items (kind, case_id, item): means of the cases that expect or have any."""
    a = actual.groupBy("kind", "case_id").agg(F.collect_set("item").alias("a"), (F.count("*") - F.countDistinct("item")).alias("dup"))
    e = expected.groupBy("kind", "case_id").agg(F.collect_set("item").alias("e"))
    none = F.array().cast("array<string>")
    j = a.join(e, ["kind", "case_id"], "full").withColumns({"a": F.coalesce("a", none), "e": F.coalesce("e", none)})
    p, r = precision_recall(F.col("a"), F.col("e"))
    return j.groupBy("kind").agg(F.round(F.avg(p), 6).alias("precision"), F.round(F.avg(r), 6).alias("recall"), F.sum(F.coalesce("dup", F.lit(0))).alias("duplicates"))


def draft_promotion(drafts: DataFrame, existing: DataFrame, share: float = 0.2) -> DataFrame:
    """One row: total, sampled, rejected, collisions, promote of drafts (id, sampled, accepted) against a set's ids (id)."""
    known = existing.select("id").distinct().withColumn("_known", F.lit(True))
    j = drafts.join(known, "id", "left")
    out = j.agg(F.count("*").alias("total"), F.count_if("sampled").alias("sampled"), F.count_if(F.col("sampled") & ~F.col("accepted")).alias("rejected"), F.count_if("_known").alias("collisions"))
    return out.withColumn("promote", (F.col("total") > 0) & (F.col("sampled") >= share * F.col("total")) & (F.col("rejected") == 0) & (F.col("collisions") == 0))


def job_states(events: DataFrame, now: Column) -> DataFrame:
    """job_id, state, attempts, retry_at: jobs after their events (job_id, at, seq, state); failed ones wait 2^n seconds, 300 at most."""
    out = events.groupBy("job_id").agg(F.max_by(F.struct("state", "at"), F.struct("at", "seq")).alias("v"), F.count_if(F.col("state") == "failed").alias("attempts"))
    wait = F.least(F.lit(300.0), F.pow(F.lit(2.0), "attempts")).cast("int")
    retry = F.when(F.col("v.state") == "failed", F.col("v.at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait))
    return out.select("job_id", F.col("v.state").alias("state"), "attempts", retry.alias("retry_at"), F.coalesce(retry <= now, F.lit(False)).alias("due"))


def corpus_fingerprint(rows: DataFrame, *columns: str, levels: tuple[int, ...] = (4, 2)) -> DataFrame:
    """fingerprint: SHA-256 over the sorted hashes of rows, by a tree: the hashes of rows that share 4 digits are hashed in order, those of
    2 digits' hashes again, and at last all of them. No list is longer than a 65,536th of the rows, or than 256."""
    h = rows.select(F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns]), 256).alias("h"))
    now = h.select("h", F.col("h").alias("at"))
    for width in (*levels, 0):
        own = F.array_sort(F.collect_list(F.struct("at", "h")))
        now = now.groupBy(F.substring("at", 1, width).alias("b")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["h"]), ""), 256).alias("h")).select("h", F.col("b").alias("at"))
    return now.select(F.col("h").alias("fingerprint"))


def preferences(events: DataFrame) -> DataFrame:
    """owner, key, value: the latest choice of each owner for each key (owner, key, value, at, seq)."""
    return events.groupBy("owner", "key").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


def context_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths (edge_ids) whose edges are all accepted and freshly evidenced: (id, status, fresh)."""
    bad = edges.where((F.col("status") != "accepted") | ~F.coalesce("fresh", F.lit(False))).select(F.col("id").cast("string").alias("edge"))
    keyed = paths.withColumn("_p", F.xxhash64("start_id", "end_id", F.array_join("edge_ids", ",")))
    hit = keyed.select("_p", F.explode("edge_ids").alias("edge")).join(bad, "edge", "left_semi").select("_p").distinct()
    return keyed.join(hit, "_p", "left_anti").drop("_p")


def mined(proposed: DataFrame, types: DataFrame, units: DataFrame) -> DataFrame:
    """id, skip (null: kept) of proposals (id, fingerprint, entity_type, unit_id): unknown type, unknown evidence, or seen before."""
    j = proposed.join(types.select(F.col("type").alias("entity_type"), F.lit(True).alias("_t")).distinct(), "entity_type", "left").join(units.select("unit_id", F.lit(True).alias("_u")).distinct(), "unit_id", "left")
    first = proposed.groupBy("fingerprint").agg(F.min("id").alias("_first"))
    why = F.when(F.col("_t").isNull(), "unknown_type").when(F.col("_u").isNull(), "unknown_evidence").when(F.col("id") != F.col("_first"), "duplicate")
    return j.join(first, "fingerprint").select("id", why.alias("skip"))
