"""What happens to ranked lists: fusion, reranking, diversity, packing, abstention, expansion. Rows: query_id, unit_id, rank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quernstone.functions import text as T
from quernstone.sources.sinks import kept

MISSING = 10**9


def rrf(lists: DataFrame, constant: int = 60) -> DataFrame:
    """query_id, unit_id, score, lexical_rank, vector_rank, rank from (channel, query_id, unit_id, rank): sums of 1 / (constant + rank)."""

    def of(channel: str):
        return F.min(F.when(F.col("channel") == channel, F.col("rank")))

    fused = lists.groupBy("query_id", "unit_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), of("lexical").alias("lexical_rank"), of("vector").alias("vector_rank"))
    order = [F.desc("score"), F.coalesce("lexical_rank", F.lit(MISSING)), F.coalesce("vector_rank", F.lit(MISSING)), F.col("unit_id")]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rerank(hits: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` hits in order of their new scores (query_id, unit_id, rerank_score), then the others as they were."""
    w = Window.partitionBy("query_id")
    head = F.col("rank") <= depth
    joined = hits.join(scores, ["query_id", "unit_id"], "left").withColumnRenamed("rank", "old_rank")
    head = F.col("old_rank") <= depth
    order = w.orderBy(F.when(head, 0).otherwise(1), F.when(head, F.coalesce("rerank_score", F.lit(0.0))).desc_nulls_last(), "old_rank")
    return joined.withColumn("rerank_score", F.when(head, F.coalesce("rerank_score", F.lit(0.0)))).withColumn("rank", F.row_number().over(order))


def diversify(hits: DataFrame, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` hits of a document while there are others, then the rest in order as backfill; ``limit`` in all.

    hits: query_id, unit_id, document_id, rank. A hit without document is a document of its own. cap <= 0: no cap.
    """
    if cap <= 0:
        return hits.where(F.col("rank") <= limit).withColumn("diversity_backfill", F.lit(False)).withColumn("position", F.col("rank"))
    document = F.coalesce(F.col("document_id").cast("string"), F.concat(F.lit("unit:"), F.col("unit_id").cast("string")))
    nth = F.row_number().over(Window.partitionBy("query_id", document).orderBy("rank"))
    flagged = hits.withColumn("diversity_backfill", nth > cap)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("diversity_backfill", "rank"))
    return flagged.withColumn("position", place).where(F.col("position") <= limit)


def pack(hits: DataFrame, max_chars: int, limit: int, floor: int = 8000) -> DataFrame:
    """How many characters of each hit (query_id, unit_id, rank, n_chars) go into a context of max_chars."""
    cap = max(floor, max_chars // limit)
    before = F.coalesce(F.sum(F.least("n_chars", F.lit(cap))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = hits.withColumn("room", F.least(F.lit(cap), F.greatest(F.lit(0), F.lit(max_chars) - before)))
    return out.withColumn("taken", F.least("n_chars", "room")).withColumn("truncated", F.col("n_chars") > F.col("room")).drop("room")


def abstained(queries: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Queries that have content tokens, none of which occurs; frequencies: (term, df)."""
    each = queries.select("query_id", F.explode(T.content_tokens("query")).alias("term")).join(frequencies, "term", "left")
    return each.groupBy("query_id").agg(F.max(F.coalesce("df", F.lit(0))).alias("most")).where("most = 0").select("query_id")


#: Bytes of aliases that one automaton holds, and of queries that run through it at a time, both on average.
PATTERN_BYTES, QUERY_BYTES = 2 << 20, 2 << 20


def resolve(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, entity_id, position, longest: entities (entity_id, alias) with an alias anywhere in the query's text.

    Aliases are measured and dealt into as many parts as it takes for an automaton of each (Aho and Corasick's) to stay within PATTERN_BYTES. Blocks of
    queries run through each part's automaton once, whatever the number of its aliases. An alias without characters is in no query.
    """
    known = kept(aliases.where("alias <> ''").select("entity_id", F.lower("alias").alias("alias")).distinct())
    asked = kept(queries.where("query is not null").select("query_id", F.lower("query").alias("q")))
    kinds = {c: df.schema[c].dataType for df, c in ((known, "entity_id"), (asked, "query_id"))}
    out = StructType([StructField("query_id", kinds["query_id"]), StructField("entity_id", kinds["entity_id"]), StructField("position", IntegerType()), StructField("longest", IntegerType())])
    parts, blocks = (max(1, -(-int(df.agg(F.coalesce(F.sum(F.octet_length(c) + 16), F.lit(0))).first()[0]) // most)) for df, c, most in ((known, "alias", PATTERN_BYTES), (asked, "q", QUERY_BYTES)))
    packed = known.groupBy(F.pmod(F.xxhash64("alias"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list("entity_id").alias("entities"), F.collect_list("alias").alias("aliases"))
    # ids twice or more are dealt by their texts, so that no block grows with them
    dealt = asked.groupBy(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).alias("block")).agg(F.collect_list("query_id").alias("ids"), F.collect_list("q").alias("texts"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        last, machine = None, None
        for b in batches:
            for k in range(b.num_rows):
                part, entities, ids = b.column(0)[k].as_py(), b.column(1)[k].values, b.column(3)[k].values
                if part != last:
                    machine, own = ahocorasick.Automaton(), {}
                    for i, alias in enumerate(b.column(2)[k].as_py()):
                        own.setdefault(alias, []).append(i)
                    for alias, which in own.items():
                        machine.add_word(alias, (len(alias), which))
                    machine.make_automaton()
                    last = part
                rows, found = [], []
                for i, text in enumerate(b.column(4)[k].as_py()):
                    best: dict[int, tuple[int, int]] = {}
                    for end, (size, which) in machine.iter(text):
                        for e in which:
                            at, longest = best.get(e, (end, 0))
                            best[e] = min(at, end - size + 1), max(longest, size)
                    for e, (at, longest) in best.items():
                        rows.append(i)
                        found.append((e, at + 1, longest))
                if rows:
                    e, at, longest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), entities.take(pa.array(e)), pa.array(at, pa.int32()), pa.array(longest, pa.int32())], names=["query_id", "entity_id", "position", "longest"])

    met = dealt.join(packed, "part").sortWithinPartitions("part").select("part", "entities", "aliases", "ids", "texts")
    # an entity's aliases may be in several parts, and a query twice in the table
    return met.mapInArrow(run, out).groupBy("query_id", "entity_id").agg(F.min("position").alias("position"), F.max("longest").alias("longest"))


def expand(queries: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, expansions: names (entity_id, name) of entities in the query that it doesn't spell out, by place."""
    found = resolve(queries, aliases).join(names, "entity_id").join(queries.select("query_id", F.lower("query").alias("q")), "query_id")
    fresh = found.where(~F.contains("q", F.lower("name")))
    ordered = F.array_sort(F.collect_list(F.struct("position", (-F.col("longest")).alias("n"), "entity_id", "name")))
    lists = fresh.groupBy("query_id").agg(F.transform(ordered, lambda x: x["name"]).alias("expansions"))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("expansions", F.array().cast("array<string>")).alias("expansions"))
