"""One search over a query table: mode, candidates, fusion, reranking, diversity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import lexical, postings, rank, vector

MODES = ("lexical", "vector", "hybrid", "reranked")
#: Turns candidates (query_id, index, document) and queries into (query_id, index, score).
Reranker = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Search:
    """Parameters of a search; units: (unit_id, document_id, body), vectors: (vec_id, embedding)."""

    units: DataFrame
    vectors: DataFrame | None = None
    reranker: Reranker = lexical.bm25_rerank
    pool: int = 100
    depth: int = 40
    cap: int = 3
    #: Stored postings of the units; without them each search reads their texts.
    index: postings.Index | None = None
    #: Terms of a query at most, the longest ones; all where texts are read.
    most: int | None = None

    def mode(self, wanted: str | None) -> str:
        """What was asked for; hybrid by default where there are vectors, else lexical."""
        if wanted is None:
            return "lexical" if self.vectors is None else "hybrid"
        if wanted not in MODES:
            raise ValueError(f"no such mode: {wanted}")
        if wanted != "lexical" and self.vectors is None:
            raise ValueError(f"{wanted} needs vectors")
        return wanted

    def run(self, queries: DataFrame, limit: int = 10, mode: str | None = None) -> DataFrame:
        """query_id, unit_id, document_id, rank, position, diversity_backfill, mode. queries: (query_id, query, q), q being a vector.

        Queries without a letter or digit are left out. Where vectors were taken by default and a query has none, its lexical hits
        stand alone, flagged as degraded.
        """
        if not 1 <= limit <= 100:
            raise ValueError("a limit is from 1 to 100")
        chosen, pool = self.mode(mode), min(100, max(limit, self.pool))
        asked = queries.where(~T.blank_or_symbols("query"))
        lists = []
        if chosen != "vector":
            found = lexical.bm25(self.units, asked, pool, most=self.most) if self.index is None else postings.bm25(self.index, asked, pool, self.most or postings.TERMS)
            lists.append(found.select(F.lit("lexical").alias("channel"), "query_id", "unit_id", "rank"))
        if chosen != "lexical":
            found = vector.cosine_topk(self.vectors, asked.where("q is not null"), pool)
            lists.append(found.select(F.lit("vector").alias("channel"), "query_id", F.col("vec_id").alias("unit_id"), "rank"))
        hits = rank.rrf(lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])).select("query_id", "unit_id", "rank")
        hits = hits.join(self.units.select("unit_id", "document_id", "body"), "unit_id")
        if chosen == "reranked":
            head = hits.where(F.col("rank") <= self.depth).select("query_id", F.col("unit_id").alias("index"), F.col("body").alias("document"))
            scores = self.reranker(head, asked.select("query_id", "query")).select("query_id", F.col("index").alias("unit_id"), F.col("score").alias("rerank_score"))
            hits = rank.rerank(hits.drop("body"), scores, self.depth).select("query_id", "unit_id", "document_id", "rank")
        out = rank.diversify(hits.select("query_id", "unit_id", "document_id", "rank"), self.cap, limit).withColumn("mode", F.lit(chosen))
        if mode is None and chosen == "hybrid":
            return out.join(asked.select("query_id", F.col("q").isNull().alias("degraded")), "query_id")
        return out.withColumn("degraded", F.lit(False))
