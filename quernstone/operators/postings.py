"""A stored index of terms: postings in blocks, built once, kept up to date by segments, and searched without reading a text.

A segment's units are dealt into blocks of about UNITS by hash. For each term and block a row holds the units that have the term (as distances from the first
one's number), their counts and lengths, and what bounds their scores: the greatest count and the least length for each occurrence. Rows lie in folders by hash of
the term, ordered by term, so that a search opens the folders of its terms alone and skips what lies between them.

``update`` adds a segment of new and changed units, and notes for each term which units it has lost; ``merge`` makes one segment of all, from
postings alone. Both commit a new version of the manifest: searches that run meanwhile read the version that they began with.

``bm25`` finds the best units block by block: the bounds of a query's terms are added up for each block, the most promising blocks are scored
first, and of the others only those whose bound reaches the score of the k-th unit found so far. The result is that of scoring all.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quernstone.functions import text as T
from quernstone.operators.ranking import K1, B, idf, ranked
from quernstone.sources import manifest
from quernstone.sources.sinks import kept

#: Units in a block, on average; folders of terms.
UNITS, BUCKETS = 64, 32
#: Terms of a query at most, the longest ones.
TERMS = 64
#: Blocks of a query that are scored before any is left out. An index of no more than DIRECT blocks is scored whole: to find bounds would take longer.
FIRST, DIRECT = 4, 4096
#: Terms that are named in the filter of a scan; more come by a join.
NAMED = 512
#: Scores are rounded to six places: what could round up to the k-th score is looked at.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """Where an index lies, what it calls a unit, and how texts become terms. grams: whether parts of terms can be sought."""

    spark: SparkSession
    root: str
    tokens: Callable[[Column], Column]
    key: str = "unit_id"
    grams: bool = False

    def kind(self) -> str:
        """The type of a unit's key."""
        return self.spark.read.parquet(f"{self.root}/units/{self.version()['segments'][0]['id']}").schema["key"].dataType.simpleString()

    def version(self) -> dict:
        return manifest.latest(self.spark, self.root).entries


def bucket(term: str | Column) -> Column:
    return (F.crc32(F.col(term).cast("binary") if isinstance(term, str) else term.cast("binary")) % BUCKETS).cast("int")


def _counted(index: Index, units: DataFrame, body: str) -> DataFrame:
    """(key, term, tf, len); a unit without terms has one row without term."""
    each = units.select(F.col(index.key).alias("key"), index.tokens(F.col(body)).alias("t")).select("key", F.greatest(F.lit(0), F.coalesce(F.size("t"), F.lit(0))).alias("len"), F.explode_outer("t").alias("term"))
    return each.groupBy("key", "len", "term").agg(F.count("*").cast("int").alias("tf"))


def _segment(index: Index, counted: DataFrame) -> dict | None:
    """Writes a segment of (key, term, tf, len); its entry of the manifest."""
    counted = kept(counted)
    units = counted.groupBy("key").agg(F.first("len").alias("len"))
    name = uuid.uuid4().hex
    units.write.parquet(f"{index.root}/units/{name}")
    n, total = index.spark.read.parquet(f"{index.root}/units/{name}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    if not n:
        return None
    blocks = -(-n // UNITS)
    rows = counted.where("term is not null").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    grouped = rows.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("key", "tf", "len"))).alias("p"), F.max("tf").alias("max_tf"), F.min(F.col("len") / F.col("tf")).alias("min_ratio"), F.sum("tf").alias("cf"))
    numbers = isinstance(counted.schema["key"].dataType, IntegralType)
    base = F.col("p")[0]["key"]
    units_of = F.transform("p", lambda x: x["key"] - base) if numbers else F.col("p.key")
    out = grouped.select(bucket("term").alias("bucket"), "term", "block", F.size("p").alias("n"), "cf", "max_tf", "min_ratio", (base if numbers else F.lit(None).cast("long")).alias("base"), units_of.alias("units"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))
    order = ("bucket", "term", "block")
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{index.root}/postings/{name}")
    if index.grams:
        words = rows.select("term").distinct().withColumn("gram", F.explode(grams_of(F.col("term"))))
        words.select(bucket("gram").alias("bucket"), "gram", "term").repartitionByRange("bucket", "gram", "term").sortWithinPartitions("bucket", "gram", "term").write.partitionBy("bucket").parquet(f"{index.root}/grams/{name}")
    return {"id": name, "n": n, "total": total}


def build(index: Index, units: DataFrame, body: str = "body") -> Index:
    """A new index of ``units`` (key, body), in place of what its folder held."""
    made = _segment(index, _counted(index, units, body))
    manifest.update(index.spark, index.root, lambda _: {"segments": [made] if made else [], "lost": []})
    return index


def _units(index: Index, entries: dict) -> DataFrame | None:
    """(segment, key, len) of all live units."""
    out = None
    for s in entries.get("segments", ()):
        one = index.spark.read.parquet(f"{index.root}/units/{s['id']}").select(F.lit(s["id"]).alias("segment"), "key", "len")
        out = one if out is None else out.unionByName(one)
    lost = _lost(index, entries)
    return out if out is None or lost is None else out.join(lost.select("segment", "key").distinct(), ["segment", "key"], "left_anti")


def _lost(index: Index, entries: dict) -> DataFrame | None:
    """(bucket, term, segment, key) of postings that are no more; a unit without terms has one without term."""
    out = None
    for name in entries.get("lost", ()):
        one = index.spark.read.schema(f"term string, segment string, key {index.kind()}, bucket int").parquet(f"{index.root}/lost/{name}")
        out = one if out is None else out.unionByName(one)
    return out


def _postings(index: Index, entries: dict) -> DataFrame | None:
    out = None
    for s in entries.get("segments", ()):
        one = index.spark.read.parquet(f"{index.root}/postings/{s['id']}").withColumn("segment", F.lit(s["id"]))
        out = one if out is None else out.unionByName(one)
    return out


def exploded(blocks: DataFrame, *also: str) -> DataFrame:
    """(also, segment, term, key, tf, len) of each posting."""
    each = blocks.select(*also, "segment", "term", "base", F.explode(F.arrays_zip("units", "tfs", "lens")).alias("p"))
    kind = blocks.schema["units"].dataType.elementType
    unit = F.coalesce(F.col("base"), F.lit(0)) + F.col("p.units") if isinstance(kind, IntegralType) else F.col("p.units")
    return each.select(*also, "segment", "term", unit.cast(kind).alias("key"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))


def update(index: Index, changed: DataFrame, removed: DataFrame, body: str = "body") -> Index:
    """Units of ``changed`` (key, body) are new or replace those of the same key, units of ``removed`` (key) go. Only their postings are written."""
    entries = index.version()
    units = _units(index, entries)
    gone = changed.select(F.col(index.key).alias("key")).unionByName(removed.select(F.col(index.key).alias("key"))).distinct()
    lost, sizes = None, {}
    if units is not None:
        gone = kept(units.join(gone, "key"))
        sizes = {r["segment"]: (r["n"], r["total"]) for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()}
    if sizes:
        name = uuid.uuid4().hex
        rows = exploded(_postings(index, entries)).join(gone.select("segment", "key"), ["segment", "key"])
        dead = _lost(index, entries)
        if dead is not None:
            rows = rows.join(dead.where("term is not null"), ["segment", "term", "key"], "left_anti")
        rows = rows.select("term", "segment", "key").unionByName(gone.where("len = 0").select(F.lit(None).cast("string").alias("term"), "segment", "key"))
        rows.withColumn("bucket", F.coalesce(bucket("term"), F.lit(0))).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("bucket").parquet(f"{index.root}/lost/{name}")
        lost = name
    made = _segment(index, _counted(index, changed, body))

    def change(now: dict) -> dict:
        if now != entries:
            raise manifest.Conflict("the index has changed since its postings were looked up")
        left = [{**s, "n": s["n"] - sizes.get(s["id"], (0, 0))[0], "total": s["total"] - sizes.get(s["id"], (0, 0))[1]} for s in now.get("segments", [])]
        return {"segments": left + ([made] if made else []), "lost": now.get("lost", []) + ([lost] if lost else [])}

    manifest.update(index.spark, index.root, change, tries=1)
    return index


def merge(index: Index) -> Index:
    """One segment of all live postings; a version as any other, that older searches needn't wait for."""
    entries = index.version()
    units, postings, lost = _units(index, entries), _postings(index, entries), _lost(index, entries)
    if units is None:
        return index
    rows = exploded(postings)
    if lost is not None:
        rows = rows.join(lost.where("term is not null").select("segment", "term", "key"), ["segment", "term", "key"], "left_anti")
    bare = units.where("len = 0").select("key", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), "len")
    made = _segment(index, rows.select("key", "term", "tf", "len").unionByName(bare))

    def change(now: dict) -> dict:
        if now != entries:
            raise manifest.Conflict("the index has changed since it was read")
        return {"segments": [made] if made else [], "lost": []}

    manifest.update(index.spark, index.root, change, tries=1)
    return index


def _of_terms(rows: DataFrame, terms: DataFrame, column: str = "term") -> DataFrame:
    """``rows`` (bucket, term) of ``terms`` (term). A few terms are named to the scan, which then opens their folders and row groups alone."""
    few = [r["term"] for r in terms.select("term").where("term is not null").distinct().limit(NAMED + 1).collect()]
    if len(few) > NAMED:
        own = terms.select(F.col("term").alias(column)).distinct().withColumn("bucket", bucket(column))
        return rows.join(own, ["bucket", column], "left_semi")
    return rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in few})) & F.col(column).isin(few))


def asked_terms(index: Index, queries: DataFrame, most: int = TERMS) -> DataFrame:
    """(query_id, term): the distinct terms of each query (query_id, query), the longest ``most``."""
    return queries.select("query_id", F.explode(T.capped_terms(index.tokens(F.col("query")), most)).alias("term"))


def vocabulary(index: Index, prefix: str = "") -> DataFrame:
    """term, df (units), cf (places) of the terms with a prefix, from the counts of blocks."""
    entries = index.version()
    postings, lost = _postings(index, entries), _lost(index, entries)
    none = index.spark.createDataFrame([], "term string, df long, cf long")
    if postings is None:
        return none
    found = postings.where(F.col("term").startswith(prefix)) if prefix else postings
    if lost is None:
        return found.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("cf").cast("long").alias("cf"))
    gone = lost.where(F.col("term").startswith(prefix) if prefix else F.col("term").isNotNull()).select("segment", "term", "key")
    return exploded(found).join(gone, ["segment", "term", "key"], "left_anti").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """(term, df) of those of ``terms`` (term) that units have."""
    entries = index.version()
    postings, lost = _postings(index, entries), _lost(index, entries)
    if postings is None:
        return index.spark.createDataFrame([], "term string, df long")
    df = _of_terms(postings, terms).select("term", F.col("n").cast("long").alias("n"))
    if lost is not None:
        df = df.unionByName(_of_terms(lost, terms).select("term", F.lit(-1).cast("long").alias("n")))
    return df.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")


def found(index: Index, terms: DataFrame) -> DataFrame:
    """(term, key, tf, len) of the live postings of ``terms`` (term)."""
    entries = index.version()
    postings, lost = _postings(index, entries), _lost(index, entries)
    if postings is None:
        raise ValueError("an index without units")
    rows = exploded(_of_terms(postings, terms))
    if lost is not None:
        rows = rows.join(_of_terms(lost, terms).select("segment", "term", "key"), ["segment", "term", "key"], "left_anti")
    return rows.drop("segment")


@dataclass(frozen=True)
class Plan:
    """What a search reads: bounds (query_id, segment, block, bound) and which blocks are scored (none where all are), and the scores (query_id, key, score)."""

    bounds: DataFrame | None
    first: DataFrame | None
    rest: DataFrame | None
    scores: DataFrame


def _weight(tf: Column, length: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def plan(index: Index, queries: DataFrame, k: int | None, most: int = TERMS) -> Plan | None:
    """The scores (query_id, key, score) of all units that can be among the best k of a query (of all, without k); None without units."""
    entries = index.version()
    n, total = (sum(s[x] for s in entries.get("segments", ())) for x in ("n", "total"))
    if not n:
        return None
    avgdl = max(1.0, total / n)
    asked = asked_terms(index, queries, most)
    blocks, lost = _of_terms(_postings(index, entries), asked), _lost(index, entries)
    lost = None if lost is None else kept(_of_terms(lost, asked).select("segment", "term", "key"))
    df = blocks.select("term", F.col("n").cast("long").alias("n"))
    df = (df if lost is None else df.unionByName(lost.select("term", F.lit(-1).cast("long").alias("n")))).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
    own = asked.join(df.select("term", idf(F.lit(n), F.col("df")).alias("idf")), "term")
    direct = k is None or -(-n // UNITS) <= DIRECT
    own = own if direct else kept(own)

    def scored(chosen: DataFrame | None) -> DataFrame:
        # whole blocks meet queries before their postings are spread out
        met = blocks.join(own, "term")
        met = met if chosen is None else met.join(chosen.select("query_id", "segment", "block"), ["query_id", "segment", "block"])
        rows = exploded(met, "query_id", "idf")
        if lost is not None:
            rows = rows.join(lost, ["segment", "term", "key"], "left_anti")
        part = F.col("idf") * _weight(F.col("tf"), F.col("len"), avgdl)
        return rows.groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score"))

    if direct:
        return Plan(None, None, None, scored(None))
    # the greatest count and the least length an occurrence: no posting of the block weighs more
    most_weight = (K1 + 1) / (1 + K1 * ((1 - B) / F.col("max_tf") + B * F.col("min_ratio") / avgdl))
    bounds = kept(blocks.select("segment", "block", "term", most_weight.alias("w")).join(own, "term").groupBy("query_id", "segment", "block").agg(F.sum(F.col("idf") * F.col("w")).alias("bound")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
    placed = bounds.withColumn("place", place)
    first = kept(placed.where(F.col("place") <= FIRST).drop("place"))
    known = kept(scored(first))
    least = ranked(known, k, "key").where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    others = placed.where(F.col("place") > FIRST).drop("place").join(least, "query_id", "left")
    rest = kept(others.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least"))
    return Plan(bounds, first, rest, known.unionByName(scored(rest)))


def bm25(index: Index, queries: DataFrame, k: int | None, most: int = TERMS) -> DataFrame:
    """query_id, key, score, rank by BM25 over all units of the index, as ``lexical.bm25`` gives it from texts."""
    made = plan(index, queries, k, most)
    if made is None:
        return index.spark.createDataFrame([], queries.select("query_id").schema.add(index.key, "long").add("score", "double").add("rank", "integer"))
    return ranked(made.scores.withColumnRenamed("key", index.key), k, index.key)


def cost(index: Index, queries: DataFrame, k: int, most: int = TERMS) -> DataFrame:
    """query_id, blocks, scored: how many blocks hold a query's terms, and how many of them were scored."""
    made = plan(index, queries, k, most)
    if made is None or made.bounds is None:
        raise ValueError("an index as small as this is scored whole")
    some = made.first.unionByName(made.rest).groupBy("query_id").agg(F.count("*").alias("scored"))
    return made.bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(some, "query_id")


def grams_of(word: Column) -> Column:
    """The distinct parts of one, two and three characters of a word."""
    return F.array_distinct(F.concat(*[T.ngrams(word, n) for n in (1, 2, 3)]))


def containing(index: Index, parts: DataFrame) -> DataFrame:
    """(part, term): terms of the index that hold each of ``parts`` (part, not empty) anywhere.

    A part of up to three characters is a gram itself. Of a longer one the two rarest trigrams are looked up, and what has both is compared.
    """
    entries = index.version()
    grams = None
    for s in entries.get("segments", ()):
        one = index.spark.read.parquet(f"{index.root}/grams/{s['id']}")
        grams = one if grams is None else grams.unionByName(one)
    if grams is None:
        return index.spark.createDataFrame([], "part string, term string")
    parts = kept(parts.select("part").where("part <> ''").distinct())
    size = F.length("part")
    own = F.when(size <= 3, F.array("part")).otherwise(F.array_distinct(T.ngrams(F.col("part"), 3)))
    sought = kept(parts.select("part", F.explode(own).alias("gram")))
    rows = kept(_of_terms(grams, sought.select(F.col("gram").alias("term")), "gram").select("gram", "term").distinct())
    many = rows.groupBy("gram").agg(F.count("*").alias("many"))
    # a gram that no term has rules its part out
    rare = sought.join(many, "gram", "left").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.coalesce("many", F.lit(0)), "gram"))).where("place <= 2")
    sizes = rare.groupBy("part").agg(F.count("*").alias("needed"))
    both = rare.join(rows, "gram").groupBy("part", "term").agg(F.count("*").alias("had")).join(sizes, "part").where("had = needed")
    return both.where(F.contains("term", "part")).select("part", "term")
