"""The stored index against searches of texts, before and after updates and merges; versions against racing writers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import lexical, postings, rank
from quernstone.operators.graph import closure
from quernstone.sources import manifest

U = "unit_id long, body string"


def texts(rnd, ids, size=60):
    vocabulary = [f"w{i}" for i in range(80)] + ["계약서", "변경계약", "the", "a"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, None if i % 41 == 40 else " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 3, size, 4 * size])))) for i in ids]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(1, "w70 w3"), (2, "the a w0"), (3, "계약서 w55"), (4, "nowhere"), (5, "w79"), (6, " ".join(f"w{i}" for i in range(80)))], "query_id long, query string")


@pytest.mark.parametrize("named", [512, 2])
def test_index_equals_search_of_texts(spark, queries, tmp_path, monkeypatch, named):
    monkeypatch.setattr(postings, "NAMED", named)  # by name in the scan's filter, or by a join
    monkeypatch.setattr(postings, "UNITS", 8)
    monkeypatch.setattr(postings, "DIRECT", 0 if named == 2 else 4096)
    rnd = random.Random(3)
    now = dict(texts(rnd, range(200)))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), U).repartition(3)
    index = postings.build(postings.Index(spark, str(tmp_path), T.bm25_tokens), frame(now))

    def check():
        for k in (3, None):
            # the reference search reads texts; null bodies have no terms
            want = lexical.bm25(spark.createDataFrame([(i, t or "") for i, t in now.items()], U), queries.where("query_id <> 6"), k)
            assert rows(postings.bm25(index, queries.where("query_id <> 6"), k)) == rows(want)
        df = spark.createDataFrame([(t or "",) for t in now.values()], "body string").select(F.explode(T.bm25_tokens("body")).alias("term"))
        assert rows(postings.vocabulary(index).select("term", "cf")) == rows(df.groupBy("term").count())

    if named == 2:
        return check()
    old = index.version()
    for step in range(2):
        changed = dict(texts(rnd, [*range(step, 120, 7), *range(600 + step, 640, 2)]))
        removed = [i for i in range(40 + step, 200, 9) if i not in changed]
        postings.update(index, frame(changed), spark.createDataFrame([(i,) for i in [*removed, 99_999]], "unit_id long"))
        now |= changed
        for i in removed:
            now.pop(i, None)
    check()
    assert manifest.at(spark, str(tmp_path), 1).entries == old and len(index.version()["segments"]) == 3
    postings.merge(index)
    assert len(index.version()["segments"]) == 1 and not index.version()["lost"]
    check()


def test_blocks_are_skipped_and_terms_capped(spark, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "UNITS", 4)
    monkeypatch.setattr(postings, "DIRECT", 0)
    rnd = random.Random(5)
    units = spark.createDataFrame(texts(rnd, range(2000)), U)
    index = postings.build(postings.Index(spark, str(tmp_path), T.bm25_tokens), units)
    cost = {r["query_id"]: (r["blocks"], r["scored"]) for r in postings.cost(index, queries, 5).collect()}
    assert cost[2][1] < 0.5 * cost[2][0] and 4 not in cost
    terms = [r["term"] for r in postings.asked_terms(index, queries, 10).where("query_id = 6").collect()]
    assert terms == [f"w{i}" for i in range(10, 20)]  # the longest, the first of equals


def test_only_folders_of_the_terms_are_read(spark, queries, tmp_path):
    index = postings.build(postings.Index(spark, str(tmp_path), T.bm25_tokens), spark.createDataFrame(texts(random.Random(1), range(300)), U))
    all_ = postings._postings(index, index.version())
    few = postings._of_terms(all_, spark.createDataFrame([("w3",)], "term string"))
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "w3" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_index_without_units(spark, queries, tmp_path):
    index = postings.build(postings.Index(spark, str(tmp_path), T.bm25_tokens), spark.createDataFrame([], U))
    assert postings.bm25(index, queries, 5).count() == 0 and postings.vocabulary(index).count() == 0
    postings.update(index, spark.createDataFrame([(7, "w3 w4")], U), spark.createDataFrame([(9,)], "unit_id long"))
    assert [r["unit_id"] for r in postings.bm25(index, queries, 5).where("query_id = 1").collect()] == [7]


def test_parts_of_terms(spark, tmp_path):
    words = ["abcabc", "xabc", "ab", "b", "계약서입니다", "abxabc", "bca"]
    index = postings.build(postings.Index(spark, str(tmp_path), lexical.words, grams=True), spark.createDataFrame([(i, w) for i, w in enumerate(words)], U))
    parts = ["abc", "ab", "b", "cab", "abca", "약서입", "bcabx", "abcx"]
    got = rows(postings.containing(index, spark.createDataFrame([(p,) for p in [*parts, ""]], "part string")))
    assert got == sorted((p, w) for p in parts for w in words if p in w)


def occurrences(hay, term):
    return hay.count(term)


def test_lexical_search_against_plain(spark):
    rnd = random.Random(8)
    bodies = [" ".join(rnd.choice(["alpha", "alphabet", "beta", "be", "gamma-ray", "x"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    units = [(i, rnd.choice(["", "Beta gamma", None]), b, rnd.choice([None, f"f{i}.txt"])) for i, b in enumerate(bodies)]
    asked = [(1, "alpha be"), (2, " ha"), (3, "f7.txt"), (4, "gamma-ray x"), (5, "  "), (6, "zzz"), (7, "BETA")]
    df = spark.createDataFrame(units, "unit_id long, title string, body string, file_name string")
    got = rows(lexical.lexical_topk(df, spark.createDataFrame(asked, "query_id long, query string"), 7))
    want = []
    for q, text in asked:
        q_text = text.strip().lower()
        terms = list(dict.fromkeys([*q_text.split(), *__import__("re").findall(r"[0-9a-z_./:@+-]+", q_text)]))
        scored = []
        for i, title, body, name in units:
            hay = f"{title or ''}\n{body}\n{name or ''}".lower()
            s = sum(1 + min(3.0, 0.15 * occurrences(hay, t)) for t in terms if t in hay)
            if terms and s:
                scored.append((round(s + 12 * (q_text in hay) + 30 * (q_text == (name or "").lower()), 6), i))
        scored.sort(key=lambda x: (-x[0], x[1]))
        want += [(q, i, s, n + 1) for n, (s, i) in enumerate(scored[:7])]
    assert got == sorted(want)


def test_aliases_in_several_automata(spark, monkeypatch):
    monkeypatch.setattr(rank, "PATTERN_BYTES", 60)
    monkeypatch.setattr(rank, "QUERY_BYTES", 80)
    rnd = random.Random(2)
    names = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 4))) for _ in range(40)] + ["가나", "나"]
    asked = ["".join(rnd.choice("ABC ") for _ in range(12)) for _ in range(30)] + ["가나다", "", None]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    a = spark.createDataFrame([(f"e{i % 15}", n) for i, n in enumerate([*names, names[0], None])], "entity_id string, alias string")
    want = {}
    for i, text in enumerate(asked):
        for k, n in enumerate([*names, names[0]]):
            at = (text or "").lower().find(n)
            if at >= 0:
                p, size = want.get((i, f"e{k % 15}"), (at + 1, 0))
                want[i, f"e{k % 15}"] = min(p, at + 1), max(size, len(n))
    got = {(r["query_id"], r["entity_id"]): (r["position"], r["longest"]) for r in rank.resolve(q, a).collect()}
    assert got == want


def test_closure_of_long_chains_and_circles(spark):
    types = [(f"t{i}", f"t{i + 1}") for i in range(40)] + [("t40", None), ("x", "y"), ("y", "z"), ("z", "x")]
    got = {(r["type"], r["ancestor"]): r["distance"] for r in closure(spark.createDataFrame(types, "type string, parent string")).collect()}
    assert {k: v for k, v in got.items() if k[0][0] == "t"} == {(f"t{i}", f"t{j}"): j - i for i in range(41) for j in range(i, 41)}
    assert got["x", "y"] == 1 and got["x", "z"] == 2 and got["x", "x"] == 0


def test_of_two_writers_one_is_first(spark, tmp_path):
    root = str(tmp_path)
    base = manifest.commit(spark, root, manifest.latest(spark, root), {"n": 0})
    assert manifest.commit(spark, root, base, {"n": 0}) == base  # nothing new, no version
    first = manifest.commit(spark, root, base, {"n": 1})
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, root, base, {"n": 2})
    assert manifest.latest(spark, root) == first


def test_racing_writers_lose_nothing_and_readers_see_whole_versions(spark, tmp_path):
    root, seen, failed = str(tmp_path), [], []

    def write(name):
        try:
            for k in range(5):
                manifest.update(spark, root, lambda e, k=k: {"files": [*e.get("files", []), f"{name}{k}"]}, tries=40)
        except Exception as e:
            failed.append(e)

    def read():
        for _ in range(30):
            seen.append(manifest.latest(spark, root))

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    files = manifest.latest(spark, root).entries["files"]
    assert sorted(files) == sorted(f"{n}{k}" for n in "abc" for k in range(5)) and manifest.latest(spark, root).number == 15
    for v in seen:
        assert v.entries.get("files", []) == files[: v.number]
    assert manifest.expire(spark, root, keep=2) and manifest.latest(spark, root).number == 15
