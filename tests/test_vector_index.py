"""The vector index: recall against all distances, exactness with all cells open, filters, dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import vector
from quernstone.operators.vector_index import VectorIndex, build, fitted, recall, search


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    even = rng.normal(0, 1, (1500, 24))
    tight = rng.normal(0, 1, (12, 10))[rng.integers(0, 12, 900)] + rng.normal(0, 0.1, (900, 10))
    rows = [(i, [float(x) for x in v], i % 40) for i, v in enumerate([*even, *tight])] + [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1), (9003, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    return build(VectorIndex(spark, str(tmp_path_factory.mktemp("vectors"))), tables)


@pytest.fixture(scope="module")
def queries(tables):
    return tables.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recall(index, tables, queries):
    exact = vector.cosine_topk(tables, queries, 20)
    assert recall(search(index, queries, 20), exact) >= 0.9
    opened = {d: m.probes / len(m.centres) for d, m in index.models().items() if d > 2}
    assert opened[10] < 0.4  # tight groups need few cells


def test_all_cells_and_candidates_are_exact(index, tables, queries):
    got = search(index, queries, 7, probes=10**6, depth=10**6)
    assert rows(got) == rows(vector.cosine_topk(tables.where("size(embedding) > 0"), queries, 7))


def test_a_filter_that_leaves_few_opens_more_cells(index, tables, queries):
    got = search(index, queries, 10, where=F.col("label") == 3, probes=1, depth=200)
    want = vector.cosine_topk(tables.where("label = 3 and size(embedding) > 2"), queries, 10)
    assert {r["vec_id"] % 40 for r in got.collect()} == {3}
    n = {r["query_id"]: r["n"] for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert n == {r["query_id"]: r["n"] for r in want.groupBy("query_id").agg(F.count("*").alias("n")).collect()}


def test_queries_of_no_dimension_and_none(index, spark):
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [2.0, 1.0])], "query_id long, q array<double>")
    assert [r["vec_id"] for r in search(index, q, 5).collect()] == [9003]
    assert search(index, q.where("false"), 5).count() == 0


def test_codes_are_near_what_they_code():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (3000, 13))
    m = fitted(x, 3000)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cells = m.cells(u)
    assert np.linalg.norm(m.decoded(m.coded(u, cells), cells) - u, axis=1).mean() < 0.35
    assert 1 <= m.probes <= len(m.centres)


def test_recall_of_the_query(spark, sf):
    from quernstone.plans import catalog
    from quernstone.plans.search import _halves, _sizes

    exact = vector.cosine_topk(_sizes(spark, sf), _halves(spark, sf), 20)
    assert recall(catalog.QUERIES["vector_index_topk"](spark, sf), exact) >= 0.9


def test_what_a_batch_gives_out_has_a_bound(spark, monkeypatch):
    """All queries' products with a batch lay in Python at once, and a set beyond the bound met rows one by one in expressions."""
    from quernstone.operators import vector

    e = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> sin(cast(id * i AS double))) AS embedding").coalesce(1)
    q = e.where("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    want = sorted(map(tuple, vector.cosine_topk(e, q, 4).collect()))
    monkeypatch.setattr(vector, "ASKED", 50)
    assert sorted(map(tuple, vector.cosine_topk(e, q, 4).collect())) == want
    monkeypatch.setattr(vector, "BOUND", 100)
    plan = vector.cosine_topk(e, q, 4)
    assert sorted(map(tuple, plan.collect())) == want and "zip_with" not in plan._jdf.queryExecution().toString()


def test_chunks_go_out_a_few_at_a_time(spark, monkeypatch):
    from quernstone.sources import parsers

    monkeypatch.setattr(parsers, "PIECES", 3)
    texts = ["", None, "a" * 9000, "line\n" * 3000, "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [(i, n, start, piece) for i, t in enumerate(texts) for n, (start, piece) in enumerate(parsers.chunks(t or ""))]
    assert sorted(map(tuple, parsers.chunked(df, "doc_id").collect())) == want
