"""Mixing sources to target weights by capped water-filling, DataFrame functions only.

Every source s has size S (all words of its documents), weight w and cap c = epochs * S. Its target is the water
level min(c, level * w), with the level at which the targets add up to the wanted total: what capped sources can't take
is shared among the rest by weight until none is above its cap. Whole repetitions of a source are floor(target / S) of
each document; the rest of the target is taken from documents in a seeded order, whole ones first and the last in
part, so that a source's taken words are its target to less than one word.

The seeded order is found without sorting a source: sums over 256 ranges of the order's hash, then over 256 ranges of
the one in which the target falls, and only the documents of one range of those are put in order.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order of sources; a row without
doc_id takes its place in the order by its text; rows alike in doc_id and size are interchangeable, of which some are
taken and some not; a source whose documents are all empty has target 0; very long texts are counted whole; an empty table gives an empty result. Columns besides doc_id, text and
source are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import WORD, durable

SEED = 17


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """source, source_size, target for each row of ``sources`` (source, source_size): one row for a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        # sources of a lower ratio are full at this one's ratio
        .withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", (F.col("total") - F.col("full")) / F.col("open"))
    )
    level = F.max(F.when(F.col("at") <= F.col("ratio"), F.col("at"))).over(everything)
    return ranked.withColumn("level", level).select("source", "source_size", F.round(F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))), 6).alias("target"))


def _cut(docs: DataFrame, aims: DataFrame, key: str) -> DataFrame:
    """source, key, aim: the range of ``key`` in which a source's aim falls, and what is left of the aim there."""
    sums = docs.groupBy("source", key).agg(F.sum("size").alias("in_range"))
    w = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("in_range").over(w), F.lit(0)))
    aims = aims.select(F.col("source").alias("of"), "aim")
    hit = F.col("source").eqNullSafe(F.col("of")) & (F.col("before") <= F.col("aim")) & (F.col("aim") < F.col("before") + F.col("in_range"))
    return before.join(aims, hit).select("source", key, (F.col("aim") - F.col("before")).alias("aim"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of ``docs`` (doc_id, text, source)."""
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))
    rows = durable(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), at.alias("at")))
    rows = rows.withColumns({"r1": F.substring("at", 1, 2), "r2": F.substring("at", 3, 2)})
    aimed = durable(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
        .withColumn("epoch", F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target") / F.col("source_size"), 9))).otherwise(F.lit(0)).cast("long"))
        .withColumn("aim", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epoch") * F.col("source_size"))).cast("long"))
    )
    one = durable(_cut(rows, aimed.select("source", "aim"), "r1"))
    inside = rows.join(one.withColumnsRenamed({"source": "s1", "r1": "x1"}), F.col("source").eqNullSafe(F.col("s1")) & (F.col("r1") == F.col("x1"))).select("source", "r2", "size")
    two = _cut(inside, one.select("source", "aim"), "r2")
    edges = one.withColumnRenamed("r1", "x1").drop("aim").join(two.withColumnsRenamed({"source": "s2", "r2": "x2", "aim": "rest"}), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = durable(aimed.join(edges.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3").withColumnRenamed("source", "s4"))
    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("s4")))
    # whole documents below the range in which the aim ends, none above it; without such a range all or none
    place, edge = F.struct("r1", "r2"), F.struct(F.col("x1").alias("r1"), F.col("x2").alias("r2"))
    on_edge = F.coalesce(place == edge, F.lit(False))
    whole = F.when(F.col("x2").isNull(), F.col("aim") > 0).otherwise(place < edge)
    away = planned.where(~on_edge).withColumn("extra", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = planned.where(on_edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)))
    taken = (F.col("epoch") * F.col("size") + F.col("extra")).cast("long")
    return away.unionByName(within).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same mix in DuckDB; it sorts each source, which a single small machine may.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS at_hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM r
), g AS (
  SELECT *, max(CASE WHEN (total - filled) / rest <= ratio THEN (total - filled) / rest END) OVER () AS level FROM f
), t AS (
  SELECT source, source_size, round(CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END, 6) AS target FROM g
), a AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target / source_size, 9)) AS BIGINT) ELSE 0 END AS epoch FROM t
), p AS (
  SELECT d.*, a.source_size, a.target, a.epoch,
         CAST(greatest(0, round(a.target - a.epoch * a.source_size)) AS BIGINT) AS aim,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY at_hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, CAST(epoch * size + greatest(0, least(size, aim - before)) AS BIGINT) AS taken FROM p
"""
