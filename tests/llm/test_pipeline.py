"""The pipeline on the smallest tables: columns, decisions, and its parts against plain versions."""

import duckdb
import pytest

import corpus_pipeline
from quernstone.llm import queries


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    out.append(docs)
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(n))
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_order(steps):
    assert all(s.columns == steps[0].columns and s.schema == steps[0].schema for s in steps[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    sizes = [s.count() for s in steps]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] >= sizes[5] > 0


def test_decisions_follow_the_operators(spark, sf, steps):
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    bad = {r["doc_id"] for r in queries.QUERIES["op2_quality"](spark, sf).where("predicted = 0").collect()}
    assert ids[1] == ids[0] - bad
    texts = [r["text"] for r in steps[2].collect()]
    assert len(texts) == len(set(texts))
    from quernstone.llm.pii import base_spans

    assert not any(base_spans(r["text"]) for r in steps[4].collect())
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_run_is_the_last_stage(spark, sf, steps):
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, steps[5].collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "pages"):
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(str(list(r)) for r in got.collect()) == sorted(str(list(r)) for r in want.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


ODD = "doc_id long, text string, lang string, source string, n_chars long, PII string, Hit1 string, k long, Node int, taken int, own_k int, root int, size int, W array<int>, BAD_ID long, fold int, near_id int"


def odd_rows():
    text = " ".join(f"word{i}" for i in range(60))
    more = (None,) * 12
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, None, None), (None, text, "en", None), (None, None, None, None), (3, None, "en", "b"), (4, "", "en", "b"), (5, " \n", "de", "b")]
    rows += [(6, "mail me@example.org now " * 3, "en", "a"), (6, "another text of the same id", "en", "a"), (7, "x1 " * 50_000, "en", "a"), (8, text.upper(), "en", "c")]
    return [(*r, len(r[1] or ""), *more) for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    got = stage(spark, docs, sf)
    rows = got.collect()
    ids = sorted((str(r["doc_id"]) for r in rows))
    if name == "mixing":
        assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and all(r["taken"] > 0 for r in rows)
    else:
        assert got.columns == docs.columns and got.schema == docs.schema
    if name == "near_duplicates":
        # one of each group: the 60 words (1, 2, 8), texts without words (3, 4, 5), and each by itself; those without doc_id stay
        assert ids == ["1", "3", "6", "6", "7", "None", "None"]
    if name == "decontamination":
        assert len(rows) == len(odd_rows())
    if name == "personal_data":
        assert len(rows) == len(odd_rows()) and [r["text"] for r in rows if r["doc_id"] == 6 and "mail" in r["text"]] == ["mail [EMAIL] now " * 3]
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    none = stage(spark, docs.where("false"), sf)
    assert none.count() == 0 and none.columns == got.columns


def test_queries_without_documents(spark, tmp_path):
    empty = tmp_path / "none"
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string"}
    for n, s in schemas.items():
        spark.createDataFrame([], s).write.parquet(str(empty / f"{n}.parquet"))
    for name, q in queries.QUERIES.items():
        assert q(spark, str(empty)).count() == 0, name
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
