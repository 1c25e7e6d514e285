"""The reviewed graph: edges are assertions (id, subject_id, predicate, object_id, status, valid_from, valid_to)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.visibility import overlap, valid_at
from quernstone.sources.sinks import kept

RISKS = ("high", "medium", "low")


def live(edges: DataFrame, now: Column | None = None, predicates: Sequence[str] = (), status: str | None = "accepted") -> DataFrame:
    """Edges that may be walked: of a status, valid now, of the predicates asked for."""
    out = edges
    if status is not None:
        out = out.where(F.col("status") == status)
    if now is not None:
        out = out.where(valid_at(now))
    return out.where(F.col("predicate").isin(list(predicates))) if predicates else out


def both_ways(edges: DataFrame) -> DataFrame:
    """id, here, there: each edge from both ends (self-loops once), so that a step is an equi-join."""
    out = edges.select("id", F.col("subject_id").alias("here"), F.col("object_id").alias("there"))
    return out.unionByName(out.where("here <> there").select("id", F.col("there").alias("here"), F.col("here").alias("there")))


def neighbors(edges: DataFrame, start: DataFrame, direction: str = "both", limit: int | None = None) -> DataFrame:
    """entity_id, id, neighbor_id, position of the edges at each entity of ``start`` (entity_id), newest first, ties by id."""
    ways = {"out": [("subject_id", "object_id")], "in": [("object_id", "subject_id")]}
    out = None
    for here, there in ways["out"] + ways["in"] if direction == "both" else ways[direction]:
        one = edges.select("id", "valid_from", F.col(here).alias("entity_id"), F.col(there).alias("neighbor_id"))
        out = one if out is None else out.unionByName(one)
    found = out.join(start.select("entity_id").distinct(), "entity_id", "left_semi").dropDuplicates(["entity_id", "id"])
    order = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("valid_from"), "id")
    found = found.withColumn("position", F.row_number().over(order))
    return (found if limit is None else found.where(F.col("position") <= limit)).select("entity_id", "id", "neighbor_id", "position")


def paths(edges: DataFrame, pairs: DataFrame, depth: int = 4, limit: int = 20) -> DataFrame:
    """start_id, end_id, nodes, edge_ids, depth, position: simple paths between each pair, the shortest first.

    An unrolled breadth-first walk on edges made symmetric: each step joins the frontier on its last node, and paths that have arrived go no further. A first walk
    back from the ends tells how far nodes are from them by a next node, and by another one: a step is taken only if the end can be reached in time from where it
    leads without turning back at once. So none goes from a hub to leaves that lead back to it alone.
    """
    steps = kept(both_ways(edges).where("here <> there"))
    wanted = pairs.select("start_id", "end_id").distinct()
    links = kept(steps.select("here", "there").distinct())
    ends = kept(wanted.select("end_id").distinct())
    # (end_id, node, hop): walks of n steps to the end by way of hop, of which two are enough to know that one isn't where a step has come from
    last = kept(links.join(ends, links["there"] == ends["end_id"]).select("end_id", F.col("here").alias("node"), F.col("there").alias("hop")))
    away = last.withColumn("away", F.lit(1))
    for n in range(2, depth):
        by = last.groupBy("end_id", "node").agg(F.min("hop").alias("a"), F.max("hop").alias("b"))
        longer = by.join(links, by["node"] == links["there"]).where((F.col("here") != F.col("end_id")) & ((F.col("a") != F.col("here")) | (F.col("b") != F.col("here"))))
        last = kept(longer.select("end_id", F.col("here").alias("node"), F.col("there").alias("hop")))
        away = away.unionByName(last.withColumn("away", F.lit(n)))
    place = F.row_number().over(Window.partitionBy("end_id", "node").orderBy("away", "hop"))
    two = away.groupBy("end_id", "node", "hop").agg(F.min("away").alias("away")).withColumn("place", place).where("place <= 2")
    near = kept(two.groupBy("end_id", "node").agg(F.max(F.when(F.col("place") == 1, F.col("hop"))).alias("hop"), F.min("away").alias("away"), F.max(F.when(F.col("place") == 2, F.col("away"))).alias("other")))
    # each step with what is left behind it at least
    left = F.when(F.col("hop") == F.col("here"), F.col("other")).otherwise(F.col("away"))
    onward = steps.join(near, steps["there"] == near["node"]).select("end_id", "here", "id", "there", left.alias("left")).where("here <> end_id and there <> end_id and left is not null")
    arriving = steps.join(ends, steps["there"] == ends["end_id"]).select("end_id", "here", "id", "there", F.lit(0).alias("left"))
    useful = kept(onward.unionByName(arriving))
    front = wanted.withColumn("nodes", F.array("start_id")).withColumn("edge_ids", F.array().cast("array<string>"))
    found = None
    for n in range(1, depth + 1):
        grown = front.withColumn("here", F.element_at("nodes", -1)).join(useful.where(F.col("left") <= depth - n), ["end_id", "here"]).where(~F.array_contains("nodes", F.col("there")))
        front = grown.select("start_id", "end_id", F.array_append("nodes", F.col("there")).alias("nodes"), F.array_append("edge_ids", F.col("id").cast("string")).alias("edge_ids"))
        arrived = front.where(F.element_at("nodes", -1) == F.col("end_id")).withColumn("depth", F.lit(n))
        found = arrived if found is None else found.unionByName(arrived)
        front = front.where(F.element_at("nodes", -1) != F.col("end_id"))
    order = Window.partitionBy("start_id", "end_id").orderBy("depth", F.array_join("edge_ids", ","))
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def contradictions(edges: DataFrame) -> DataFrame:
    """a_id, b_id (a_id < b_id): edges of one subject and predicate with other objects at an overlapping time.

    Of two that overlap the later one starts while the other lasts: each edge meets those of its subject and predicate that start in the spans of time it
    lasts through, a span being as long as edges last on average, so that edges lie in three spans or so and one with many others meets those of its time alone.
    Edges without a start or an end are compared with all of their subject and predicate: nearly all of these they do overlap.
    """
    bounded = F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull()
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = edges.select("id", "subject_id", "predicate", "object_id", "valid_from", "valid_to")
    inside = rows.where(bounded).withColumns({"_from": at("valid_from"), "_to": F.greatest(at("valid_from"), at("valid_to"))})
    # one number
    span = max(1, int(inside.agg(F.avg(F.col("_to") - F.col("_from"))).first()[0] or 0))

    def named(df: DataFrame, letter: str) -> DataFrame:
        return df.select("subject_id", "predicate", *[c for c in df.columns if c == "_span"], *[F.col(c).alias(f"{letter}_{c}") for c in ("id", "object_id", "valid_from", "valid_to")])

    def of(pairs: DataFrame, once: Column) -> DataFrame:
        same_time = overlap((F.col("a_valid_from"), F.col("a_valid_to")), (F.col("b_valid_from"), F.col("b_valid_to")))
        found = pairs.where(once & (F.col("a_object_id") != F.col("b_object_id")) & same_time)
        return found.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))

    first = F.floor(F.col("_from") / span)
    lasting = inside.withColumn("_span", F.explode(F.sequence(first, F.floor(F.col("_to") / span))))
    later = F.struct("b_valid_from", "b_id") > F.struct("a_valid_from", "a_id")
    near = of(named(lasting, "a").join(named(inside.withColumn("_span", first), "b"), ["subject_id", "predicate", "_span"]), later)
    open_, closed = rows.where(~bounded), rows.where(bounded)
    far = of(named(open_, "a").join(named(closed, "b"), ["subject_id", "predicate"]), F.lit(True))
    both = of(named(open_, "a").join(named(open_, "b"), ["subject_id", "predicate"]), F.col("a_id") < F.col("b_id"))
    return near.unionByName(far).unionByName(both)


def closure(types: DataFrame) -> DataFrame:
    """type, ancestor, distance (0 for itself) from (type, parent): who is what, however long the chain; a circle ends where it began.

    Each round joins the pairs found so far with themselves, so that chains of twice the length are covered, until none is new.
    """
    steps = types.where("parent is not null").select("type", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    own = types.select("type", F.col("type").alias("ancestor"), F.lit(0).alias("distance"))
    now = kept(steps.unionByName(own).groupBy("type", "ancestor").agg(F.min("distance").alias("distance")))
    before, n = -1, now.count()
    while n != before:
        on = now.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("distance").alias("_more"))
        longer = now.where("distance > 0").join(on.where("_more > 0"), "ancestor").select("type", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        now = kept(now.unionByName(longer).groupBy("type", "ancestor").agg(F.min("distance").alias("distance")))
        before, n = n, now.count()
    return now


def violations(edges: DataFrame, entities: DataFrame, types: DataFrame, predicates: DataFrame) -> DataFrame:
    """id, side of edges whose subject (object) isn't of the predicate's domain (range); predicates: (predicate, domain, range)."""
    up = closure(types).select("type", "ancestor")
    kinds = entities.select(F.col("id").alias("e"), F.col("entity_type").alias("type")).join(up, "type").groupBy("e").agg(F.collect_set("ancestor").alias("kinds"))
    joined = edges.join(predicates, "predicate")
    out = None
    for side, column, allowed in (("subject", "subject_id", "domain"), ("object", "object_id", "range")):
        one = joined.join(kinds, joined[column] == kinds["e"], "left").where(~F.coalesce(F.arrays_overlap("kinds", allowed), F.lit(False)))
        one = one.select("id", F.lit(side).alias("side"))
        out = one if out is None else out.unionByName(one)
    return out


CHANGE_RANK = {"compatible": 0, "review_required": 1, "breaking": 2}


def ontology_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, change, classification between two releases of entity types (type, parent)."""
    b, a = before.select("type", F.col("parent").alias("old"), F.lit(True).alias("was")), after.select("type", F.col("parent").alias("new"), F.lit(True).alias("is"))
    both = b.join(a, "type", "full")
    change = F.when(F.col("was").isNull(), "entity_added").when(F.col("is").isNull(), "entity_removed").when(~F.col("old").eqNullSafe(F.col("new")), "entity_parent_changed")
    return both.withColumn("change", change).where("change is not null").select(F.col("type").alias("symbol"), "change", F.when(F.col("change") == "entity_added", "compatible").otherwise("breaking").alias("classification"))


def predicate_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, change, classification between releases of predicates (predicate, domain array, risk, inverse).

    A narrower domain or a lower risk rank breaks; a wider or stricter one is compatible or for review.
    """
    b = before.select("predicate", F.col("domain").alias("d0"), F.col("risk").alias("r0"), F.col("inverse").alias("i0"), F.lit(True).alias("was"))
    a = after.select("predicate", F.col("domain").alias("d1"), F.col("risk").alias("r1"), F.col("inverse").alias("i1"), F.lit(True).alias("is"))
    lost, won = F.size(F.array_except("d0", "d1")) > 0, F.size(F.array_except("d1", "d0")) > 0
    kept = F.col("was").isNotNull() & F.col("is").isNotNull()
    change = F.array_compact(
        F.array(
            F.when(F.col("was").isNull(), F.struct(F.lit("predicate_added").alias("change"), F.lit("compatible").alias("classification"))),
            F.when(F.col("is").isNull(), F.struct(F.lit("predicate_removed").alias("change"), F.lit("breaking").alias("classification"))),
            F.when(kept & lost, F.struct(F.lit("domain_narrowed").alias("change"), F.lit("breaking").alias("classification"))),
            F.when(kept & won & ~lost, F.struct(F.lit("domain_widened").alias("change"), F.lit("compatible").alias("classification"))),
            F.when(kept & (F.col("r0") != F.col("r1")), F.struct(F.lit("risk_changed").alias("change"), F.lit("review_required").alias("classification"))),
            F.when(kept & ~F.col("i0").eqNullSafe(F.col("i1")), F.struct(F.lit("predicate_semantics_changed").alias("change"), F.lit("review_required").alias("classification"))),
        )
    )
    return b.join(a, "predicate", "full").select(F.col("predicate").alias("symbol"), F.explode(change).alias("x")).select("symbol", "x.change", "x.classification")


def uncovered(changes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Breaking symbols that a migration (symbol, target) doesn't cover."""
    return changes.where(F.col("classification") == "breaking").select("symbol").distinct().join(mapping, "symbol", "left_anti")


def migrated(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges of predicates that a migration renames, as candidates under the new name."""
    return edges.join(mapping.select(F.col("symbol").alias("predicate"), "target"), "predicate").select("id", F.col("target").alias("predicate"), "subject_id", "object_id", F.lit("proposed").alias("status"))


def review_precision(candidates: DataFrame, assertions: DataFrame) -> DataFrame:
    """predicate, approved, rejected, precision over candidates that people reviewed; a revoked assertion counts as rejected."""
    joined = candidates.join(assertions.select(F.col("source_candidate_id").alias("id"), F.col("revoked_at").isNotNull().alias("revoked")), "id", "left")
    human = joined.where(~F.coalesce("auto_approved", F.lit(False)))
    good = (F.col("status") == "approved") & ~F.coalesce("revoked", F.lit(False))
    bad = (F.col("status") == "rejected") | ((F.col("status") == "approved") & F.coalesce("revoked", F.lit(False)))
    out = human.groupBy("predicate").agg(F.count_if(good).alias("approved"), F.count_if(bad).alias("rejected"))
    return out.withColumn("precision", F.col("approved") / F.nullif(F.col("approved") + F.col("rejected"), F.lit(0)))


def auto_approvable(candidates: DataFrame, ontology: DataFrame, precision: DataFrame, confidence: float = 0.8, reviewed: int = 20, least: float = 0.95) -> DataFrame:
    """ids of candidates that need no review: low risk, sure enough, of a predicate with a good record."""
    rules = ontology.where((F.col("review") == "not_required") & (F.col("risk") == "low")).select("predicate")
    good = precision.where((F.col("approved") + F.col("rejected") >= reviewed) & (F.col("precision") >= least)).select("predicate")
    return candidates.where((F.col("status") == "proposed") & (F.col("confidence") >= confidence)).join(rules, "predicate", "left_semi").join(good, "predicate", "left_semi").select("id")


def triage(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates by risk, then confidence (unknown last), then age, then id; with their place."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("review_risk"))
    order = Window.orderBy(F.when(rank > 0, rank).otherwise(len(RISKS) + 1), F.desc_nulls_last("confidence"), "created_at", "id")
    best = candidates.orderBy(F.when(rank > 0, rank).otherwise(len(RISKS) + 1), F.desc_nulls_last("confidence"), "created_at", "id").limit(limit)
    return best.withColumn("position", F.row_number().over(order))


def proposals(events: DataFrame) -> DataFrame:
    """fingerprint, occurrence_count, payload (the latest) of proposals (fingerprint, seen_at, id, payload)."""
    return events.groupBy("fingerprint").agg(F.count("*").alias("occurrence_count"), F.max_by("payload", F.struct("seen_at", "id")).alias("payload"))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def folded(events: DataFrame, key: str = "id") -> DataFrame:
    """The state of each candidate after its review events (key, at, seq, status): the last one counts."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.count("*").alias("n_events"))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """alias, entities of aliases (entity_id, alias) that more than one entity claims."""
    return aliases.groupBy(F.lower("alias").alias("alias")).agg(F.countDistinct("entity_id").alias("entities")).where("entities > 1")
