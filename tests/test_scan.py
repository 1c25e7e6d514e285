"""Searches of a stated query set in one pass over texts, against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import lexical, postings, scan
from quernstone.plans import extra, registry, search

WORDS = ["the", "a", "an", "cat", "cats", "concat", "dog.", "Dog", "x1", "한국어", "가나다라", "the-cat", "zz", "élan"]


def texts(seed, n):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    u = spark.createDataFrame([(i, t) for i, t in enumerate(texts(1, 700))], "unit_id long, body string").repartition(3)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts(2, 30) + ["", "the"])], "query_id long, query string")
    return u, q


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k, block", [(7, 512), (7, 5), (None, 512)])
def test_bm25_in_one_pass_equals_the_index(spark, tables, tmp_path, monkeypatch, k, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    u, q = tables
    index = postings.build(postings.Index(spark, str(tmp_path / "index"), T.bm25_tokens), u)
    for most in (2, 64):
        assert rows(lexical.bm25(u, q, k, most=most)) == rows(postings.bm25(index, q, k, most))


@pytest.mark.parametrize("names, columns", [(1 << 17, 4096), (25, 3)])
def test_blocks_of_terms_lose_none(spark, tables, tmp_path, monkeypatch, names, columns):
    u, q = tables
    index = postings.build(postings.Index(spark, str(tmp_path / "index"), T.bm25_tokens), u)
    want = rows(postings.bm25(index, q, 7, 1000))
    monkeypatch.setattr(scan, "NAMES", names)
    monkeypatch.setattr(lexical, "COLUMNS", columns)
    assert rows(lexical.bm25(u, q, 7)) == want
    asked = q.select("query_id", F.array_distinct(T.bm25_tokens("query")).alias("terms"))
    own = list(scan.blocks(asked))
    assert sorted(r["query_id"] for b in own for r in b) == list(range(32)) and (len(own) > 3) == (names == 25)


@pytest.fixture
def long_items(spark, tmp_path):
    """A folder of items of 100 terms and more; each document has the shortest of them alone, or one of the others too."""
    items = [(i, " ".join([f"z{i}"] + [f"longer{i}x{n}" for n in range(100 + i)])) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = [(i, f"z{i % 3}" + (f" longer{i % 3}x{i}" if i % 2 else "") + " other" * (i % 5), "en", "src1", 9) for i in range(1, 31)]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def by_sql(folder, name):
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
        return sorted(con.sql(registry.ORACLES[name]).fetchall())


def test_hits_of_all_terms_are_counted(spark, long_items):
    got = rows(search.bm25_batch_queries(spark, long_items))
    assert [r[:2] for r in got] == [(0, 10), (1, 10), (2, 10)]
    assert got == by_sql(long_items, "bm25_batch_queries")


def test_best_units_are_found_by_all_terms(spark, long_items):
    got = rows(search.bm25_topk(spark, long_items))
    # what the context sees: English units of two of the three tiers, and every tenth
    assert {q: sum(r[0] == q for r in got) for q in range(3)} == {0: 10, 1: 10, 2: 1}
    assert got == by_sql(long_items, "bm25_topk")


def test_candidates_to_rerank_are_found_by_all_terms(spark, long_items):
    got = extra.fuzzy_rerank(spark, long_items).groupBy("query_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 10), (2, 10)]


def test_what_leaves_a_batch_doesnt_grow_with_frequent_words(spark, tables):
    u, q = tables
    asked = scan.terms_of([["the"], ["the", "cat"]])
    counts = scan.counted(u.select("unit_id", T.bm25_tokens("body").alias("t")), "unit_id", asked.number).coalesce(1)
    out = scan.scored(counts, "unit_id", [0, 1], q.schema["query_id"].dataType, lexical._bm25_kernel(asked, np.ones(2), 5.0), 4)
    assert out.count() == 8 and out.groupBy("query_id").count().count() == 2


def test_bm25_without_queries_or_units(spark, tables):
    u, q = tables
    assert lexical.bm25(u, q.limit(0), 3).count() == 0
    assert lexical.bm25(u.limit(0), q, 3).count() == 0
    assert lexical.bm25(u.limit(0), q, None).columns == ["query_id", "unit_id", "score", "rank"]


def test_parts_of_words_in_one_pass_equal_the_index(spark, tables, monkeypatch):
    u, q = tables
    q = q.where("query_id < 6 or query_id >= 30").unionByName(spark.createDataFrame([(90, "u3.txt"), (91, "the cat"), (92, "?!")], "query_id long, query string"))
    u = u.where("unit_id < 150").selectExpr("unit_id", "'' AS title", "body", "concat('u', unit_id, '.txt') AS file_name")
    index = lexical.word_index(u)
    want = rows(lexical.lexical_topk(u, q, 9, index=index))
    assert rows(lexical.lexical_topk(u, q, 9)) == want and {90, 91} <= {r[0] for r in want}
    monkeypatch.setattr(scan, "BLOCK", 4)
    assert rows(lexical.lexical_topk(u, q, 9)) == want
    assert rows(lexical.relevant_texts(u, q)) == rows(lexical.relevant_units(index, q))


def test_gate_in_one_pass_equals_the_indexes(spark, tables):
    u, q = tables
    q = q.where("query_id < 6 or query_id >= 30").unionByName(spark.createDataFrame([(90, "doc-3"), (91, "the cat"), (92, "?!")], "query_id long, query string"))
    u = u.where("unit_id < 150").selectExpr("unit_id", "concat('doc-', unit_id) AS identifier", "substr(body, 1, 12) AS title", "body")
    want = rows(lexical.gated_topk(u, q, 9, stored=lexical.gate(u)))
    assert rows(lexical.gated_topk(u, q, 9)) == want and {90, 91} <= {r[0] for r in want}


def test_reranking_reads_the_texts_of_hits_alone(spark, sf):
    out = search.rerank_head_tail(spark, sf)
    assert out.count() and not any("documents.parquet" in f for f in out.inputFiles())
