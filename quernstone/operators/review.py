"""Reviews of candidates: who may decide, what follows, and what a decision replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.visibility import scoped

# Predicates whose assertions need evidence whatever their risk.
EVIDENCE_PREDICATES = ("amends", "supersedes", "approves", "evidences", "responds_to", "records_decision")


def evidence_required(risk: Column, predicate: Column) -> Column:
    return F.coalesce(risk == "high", F.lit(False)) | predicate.isin(*EVIDENCE_PREDICATES)


def reviewed(candidates: DataFrame, evidence: DataFrame, units: DataFrame, decisions: DataFrame, context: Sequence[str]) -> DataFrame:
    """candidate_id, outcome, status, acl_scopes, snapshot_ids after the first decision on each candidate.

    candidates: (candidate_id, status, predicate, review_risk, contradicts array), evidence: (candidate_id, unit_id), units: (unit_id,
    acl_scopes, acl_snapshot_id), decisions: (candidate_id, seq, action, supersedes array). Candidates with hidden evidence aren't found; one
    that isn't proposed any more is a conflict; an approval needs evidence if its predicate or risk does, and may supersede only what the candidate
    contradicts. An assertion's scopes are all of its evidence's, else the context's.
    """
    first = decisions.groupBy("candidate_id").agg(F.min_by(F.struct("action", "supersedes"), "seq").alias("d")).select("candidate_id", "d.*")
    seen = units.where(scoped(context)).select("unit_id", "acl_scopes", "acl_snapshot_id")
    own = (
        evidence.join(seen, "unit_id", "left")
        .groupBy("candidate_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("acl_scopes").isNull()).alias("hidden"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("acl_scopes")))).alias("scopes"),
            F.array_sort(F.collect_set("acl_snapshot_id")).alias("snapshots"),
        )
    )
    j = candidates.join(first, "candidate_id").join(own, "candidate_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hidden": F.coalesce("hidden", F.lit(0))})
    approves = F.col("action") == "approve"
    none = F.array().cast("array<string>")
    outcome = (
        F.when(F.col("hidden") > 0, "not_found")
        .when(F.col("status") != "proposed", "conflict")
        .when(approves & evidence_required(F.col("review_risk"), F.col("predicate")) & (F.col("n") == 0), "evidence_required")
        .when(approves & (F.size(F.array_except(F.coalesce("supersedes", none), F.coalesce("contradicts", none))) > 0), "not_contradicted")
        .when(approves, "approved")
        .otherwise("rejected")
    )
    out = j.withColumn("outcome", outcome)
    good = F.col("outcome") == "approved"
    scopes = F.when(F.size(F.coalesce("scopes", none)) > 0, F.col("scopes")).otherwise(F.array(*map(F.lit, sorted(context))).cast("array<string>"))
    return out.select("candidate_id", "outcome", F.when(F.col("outcome").isin("approved", "rejected"), F.col("outcome")).otherwise(F.col("status")).alias("status"), F.when(good, scopes).alias("acl_scopes"), F.when(good, F.coalesce("snapshots", none)).alias("snapshot_ids"))


def assertion_states(assertions: DataFrame, outcomes: DataFrame, decisions: DataFrame, revocations: DataFrame) -> DataFrame:
    """assertion_id, status, superseded_by: active ones that an approved candidate supersedes, then those that are revoked; others keep theirs.

    Of several approvals that supersede one assertion the first by seq counts; a revocation (assertion_id) takes active ones only.
    """
    done = decisions.where("action = 'approve'").join(outcomes.where("outcome = 'approved'").select("candidate_id"), "candidate_id", "left_semi")
    by = done.select("seq", "candidate_id", F.explode("supersedes").alias("assertion_id")).groupBy("assertion_id").agg(F.min_by("candidate_id", "seq").alias("superseded_by"))
    gone = revocations.select("assertion_id").distinct().withColumn("_gone", F.lit(True))
    j = assertions.join(by, "assertion_id", "left").join(gone, "assertion_id", "left")
    replaced = (F.col("status") == "active") & F.col("superseded_by").isNotNull()
    status = F.when(replaced, "superseded").when((F.col("status") == "active") & F.col("_gone"), "revoked").otherwise(F.col("status"))
    return j.select("assertion_id", status.alias("status"), F.when(replaced, F.col("superseded_by")).alias("superseded_by"))


# What an ontology may say.
EXTRACTION = ("deterministic_when_source_identified", "deterministic_source_relation", "mixed", "semantic")
REVIEW = ("not_required", "conditional", "required")
RISK = ("low", "medium", "high")


def contract_errors(types: DataFrame, predicates: DataFrame, reviewed_predicates: DataFrame, extraction: Sequence[str] = EXTRACTION, review: Sequence[str] = REVIEW, risk: Sequence[str] = RISK) -> DataFrame:
    """symbol, error of an ontology: types (type, parent), predicates (predicate, domain, range, inverse, inverse_given, extraction, review, risk).

    Parents, domains, ranges and inverses must be known, domains and ranges not empty, inverses given (null for none), policies of their
    lists, and reviewed_predicates (predicate) those whose review is required.
    """
    known, names = types.select(F.col("type").alias("_t")).distinct(), predicates.select(F.col("predicate").alias("_p")).distinct()

    def said(rows: DataFrame, symbol: str, error: str) -> DataFrame:
        return rows.select(F.col(symbol).alias("symbol"), F.lit(error).alias("error"))

    out = [said(types.where("parent is not null").join(known, F.col("parent") == F.col("_t"), "left_anti"), "type", "unknown parent")]
    for side in ("domain", "range"):
        out.append(said(predicates.where(F.coalesce(F.size(side), F.lit(0)) <= 0), "predicate", f"empty {side}"))
        each = predicates.select("predicate", F.explode(side).alias("_v"))
        out.append(said(each.join(known, F.col("_v") == F.col("_t"), "left_anti").select("predicate").distinct(), "predicate", f"unknown {side}"))
    out.append(said(predicates.where(~F.col("inverse_given")), "predicate", "inverse not given"))
    out.append(said(predicates.where("inverse is not null").join(names, F.col("inverse") == F.col("_p"), "left_anti"), "predicate", "unknown inverse"))
    for field, allowed in (("extraction", extraction), ("review", review), ("risk", risk)):
        out.append(said(predicates.where(~F.coalesce(F.col(field).isin(list(allowed)), F.lit(False))), "predicate", f"invalid {field}"))
    must = predicates.where("review = 'required'").select("predicate")
    out.append(said(must.join(reviewed_predicates.select("predicate"), "predicate", "left_anti"), "predicate", "review not in the policy"))
    out.append(said(reviewed_predicates.select("predicate").distinct().join(must, "predicate", "left_anti"), "predicate", "policy without review"))
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every


def claimed(jobs: DataFrame, now: Column, workers: int) -> DataFrame:
    """job_id, place: the jobs that ``workers`` claim one after the other: queued and due, by priority and id."""
    due = jobs.where((F.col("status") == "queued") & (F.col("available_at") <= now)).orderBy("priority", "job_id").limit(workers)
    return due.select("job_id", F.row_number().over(Window.orderBy("priority", "job_id")).alias("place"))


def failed(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, status, available_at of running jobs (attempts, max_attempts) that have failed: queued again after 2^attempts seconds, 300 at most."""
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.least(F.lit(300.0), F.pow(F.lit(2.0), "attempts")).cast("int"))
    spent = F.col("attempts") >= F.col("max_attempts")
    return jobs.where("status = 'running'").select("job_id", F.when(spent, "failed").otherwise("queued").alias("status"), F.when(spent, F.col("available_at")).otherwise(now + wait).alias("available_at"))


def enqueued(jobs: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """key, status, attempts, payload of a queue after jobs (key, seq, payload) come in: one with a known key that had ended starts anew."""
    last = incoming.groupBy("key").agg(F.max_by("payload", "seq").alias("_new"), F.lit(True).alias("_in"))
    j = jobs.select("key", "status", "attempts", "payload").join(last, "key", "full")
    again = F.col("_in") & (F.col("status").isNull() | F.col("status").isin("succeeded", "failed"))
    return j.select("key", F.when(again, "queued").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("attempts")).alias("attempts"), F.when(F.col("_in"), F.col("_new")).otherwise(F.col("payload")).alias("payload"))


def stages(hits: DataFrame) -> DataFrame:
    """query_id, stages of hits (query_id, channels array, degraded, reranked): what a search went through, in order."""
    g = hits.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_set("channels"))).alias("c"), F.bool_or("degraded").alias("d"), F.bool_or("reranked").alias("r"))
    has = lambda x: F.array_contains("c", x)
    listed = F.array(F.lit("acl_prefilter"), F.lit("lexical"), F.when(has("vector") | F.col("d"), "vector"), F.when(has("lexical") & has("vector"), "fusion"), F.when(F.col("r"), "rerank"))
    return g.select("query_id", F.array_compact(listed).alias("stages"))
