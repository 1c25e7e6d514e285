"""Benchmark decontamination: MinHash containment search partitioned by item size, DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased; a shingle is five words in a row. An item of fewer words is one shingle of
its own length, and is sought at that length in documents. A document holds an item if it has at least 0.8 of the item's distinct
shingles, wherever they stand.

Items are partitioned by the power of two below their number of shingles. An item's MinHash sketch is its k smallest
shingle hashes, with k one more than the shingles that an item of its partition may miss: a document that holds
enough of the item must have one of the sketch, however long it is, so the search loses nothing. Each partition has a bound, the greatest hash
that a sketch of it holds, and a least size: of a document's shingles those go on whose hash is within the bound of a partition whose items
the document is long enough for. The bound of large items is low, as their sketches are few of many shingles; that of short items
isn't (``searched`` tells how many shingles go on), and these are left to the join with the sketches. Candidates are then verified by counting the very
shingles, as text, that the document has of the item.

Defined cases: a null or empty text has no shingles and is neither contaminated nor an item; a null doc_id is kept with
its own answer; rows that repeat a document get the same answer each; rows that share doc_id but not text are judged
apart; items with the same item_id are one item; a null item_id is no item; an empty table of items leaves all clean; very long
texts are exploded shingle by shingle and held in no list of them. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import durable, free

SHINGLE, SHARE = 5, 0.8


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _key() -> list[Column]:
    """What tells documents apart: also those without doc_id, and different texts under one doc_id."""
    return [F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("k1"), F.xxhash64("doc_id", "text").alias("k2")]


def shingles(df: DataFrame, keys: list[str], sizes: Column) -> DataFrame:
    """``df`` (keys, text) exploded: keys, w (all words), m (words of a shingle), n (number of such shingles), i (a shingle's place), h (its hash).

    sizes: the lengths of shingles that are wanted, as an array over the words ``w``.
    """
    w = df.withColumn("w", words(F.col("text"))).where("size(w) > 0 and w[0] <> ''")
    each = w.select(*keys, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("hw"), F.explode(sizes).alias("m"))
    each = each.withColumn("n", F.size("w") - F.col("m") + 1).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # past the shingle's length a null takes the place of a word: xxhash64 leaves it out
    return each.select(*keys, "w", "m", "n", "i", F.xxhash64("m", *[F.when(F.col("m") > k, F.get("hw", F.col("i") + k)) for k in range(SHINGLE)]).alias("h"))


def _text() -> Column:
    return F.array_join(F.slice("w", F.col("i") + 1, F.col("m")), " ")


def _sketched(items: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The items' shingles (item_id, m, h, s, n_item), and those of their sketches (item_id, n_item, m, h)."""
    of = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    index = shingles(of, ["item_id"], F.array(F.least(F.lit(SHINGLE), F.size("w")))).select("item_id", "m", "h", _text().alias("s")).distinct()
    sizes = index.groupBy("item_id").agg(F.count("*").alias("n_item"))
    index = durable(index.join(sizes, "item_id"))
    # of the partition's largest size; at least what this item may miss, and one more
    k = F.floor(F.lit(1.0 - share) * (F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1) + 1e-9) + 1
    ranks = index.groupBy("item_id", "n_item").agg(F.sort_array(F.collect_list(F.struct("h", "m"))).alias("own"))
    return index, durable(ranks.select("item_id", "n_item", F.explode(F.slice("own", F.lit(1), k.cast("int"))).alias("x")).select("item_id", "n_item", "x.m", "x.h"))


def _bounds(sketch: DataFrame, share: float) -> tuple[Column, Column]:
    """The lengths of the items' shingles, and whether a document's shingle (m, n, h) is within the bound of a partition of items that it is long enough for."""
    size = F.floor(F.log2("n_item"))
    # a row for each partition: five lengths of shingles, powers of two of sizes
    parts = sketch.groupBy("m", size.alias("size")).agg(F.max("h").alias("top"), F.min("n_item").alias("least")).collect()
    lengths = sorted({r["m"] for r in parts})
    within = F.lit(False)
    for r in parts:
        within = within | ((F.col("m") == r["m"]) & (F.col("n") >= r["least"] * share - 1e-9) & (F.col("h") <= r["top"]))
    return (F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")), within


def searched(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """One row: shingles of all documents, and how many of them are within a bound and so are looked up in the sketches."""
    lengths, within = _bounds(_sketched(items, share)[1], share)
    each = shingles(docs.select(*_key(), "text"), ["k1", "k2"], lengths)
    return each.agg(F.count("*").alias("shingles"), F.count_if(within).alias("searched"))


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """k1, k2 (see ``_key``), item_id, containment of each pair of a document and an item that it holds."""
    index, sketch = _sketched(items, share)
    lengths, within = _bounds(sketch, share)

    keyed = docs.select(*_key(), "text")
    found = shingles(keyed, ["k1", "k2"], lengths).where(within).select("k1", "k2", "m", "n", "h")
    enough = F.col("n") >= F.col("n_item") * F.lit(share) - F.lit(1e-9)
    pairs = durable(found.join(sketch, ["m", "h"]).where(enough).select("k1", "k2", "item_id").distinct())

    suspects = keyed.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    # each shingle goes on with its own words, not with all of its document's
    own = shingles(suspects, ["k1", "k2"], lengths).select("k1", "k2", "m", "h", _text().alias("own"))
    there = own.join(index.select("m", "h", "item_id", "n_item", "s"), ["m", "h"]).where(F.col("own") == F.col("s")).select("k1", "k2", "item_id", "n_item", "s")
    held = there.join(pairs, ["k1", "k2", "item_id"], "left_semi").groupBy("k1", "k2", "item_id", "n_item").agg(F.countDistinct("s").alias("n_held"))
    return held.where(F.col("n_held") >= F.col("n_item") * F.lit(share) - F.lit(1e-9)).select("k1", "k2", "item_id", (F.col("n_held") / F.col("n_item")).alias("containment"))


def report(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), containment (the highest; null for clean) of each row of ``docs``."""
    pairs = contaminated(docs, items, share)
    by_doc = pairs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("containment").alias("containment"))
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id", *_key()).join(durable(by_doc), ["k1", "k2"], "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), "containment")


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    k1, k2 = _key()
    hit1, hit2 = free(docs, "hit1"), free(docs, "hit2")
    bad = durable(contaminated(docs, items, share).select(F.col("k1").alias(hit1), F.col("k2").alias(hit2)).distinct())
    return docs.join(bad, (k1 == bad[hit1]) & (k2 == bad[hit2]), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
), b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark
), l AS (SELECT DISTINCT unnest([least(5, len(w))]) AS m FROM b WHERE w[1] <> ''
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') AS s, m
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, l WHERE w[1] <> '' AND len(w) >= m)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + m - 1], ' ') AS s, m
  FROM (SELECT item_id, w, least(5, len(w)) AS m, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM b WHERE w[1] <> '')
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
pairs AS (
  SELECT doc_id, item_id, count(*) / n_item AS containment
  FROM ds JOIN bs USING (s, m) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item
  HAVING count(*) >= n_item * 0.8 - 1e-9
), g AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, max(containment) AS containment FROM pairs GROUP BY doc_id)
SELECT d.doc_id, g.item_ids IS NOT NULL AS contaminated, coalesce(g.item_ids, []::BIGINT[]) AS item_ids, g.containment
FROM d LEFT JOIN g USING (doc_id)
"""
