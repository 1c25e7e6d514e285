"""Operators on small inputs, against plain restatements of their rules."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions import fuzzy
from quernstone.functions import text as T
from quernstone.operators import answer, evaluate, graph, ingest, lexical, rank, vector
from quernstone.operators.visibility import fully_evidenced, visible


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_analyzer_tokens(spark):
    got = one(spark, T.analyzer_tokens(F.lit("계약서를  ABC-12 계약서를")))
    assert got == ["계약서를", "계약", "약서", "서를", "계약서", "약서를", "abc-12"]
    assert one(spark, T.analyzer_tokens(F.lit(""))) == []


def test_bm25_tokens_keep_repeats(spark):
    assert one(spark, T.bm25_tokens(F.lit("Ab ab 계약서 계약"))) == ["ab", "ab", "계약서", "계약", "약서", "계약"]


def test_keywords_drop_particles_and_questions(spark):
    assert set(one(spark, T.keywords(F.lit("계약서는 언제 Renewal")))) == {"계약서", "renewal"}


def test_normalize(spark):
    df = spark.createDataFrame([("ｆｕｌｌ\x00  width",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_text("t")).collect()] == ["full width", None]
    assert spark.createDataFrame([("Straße  A",)], "t string").select(T.normalize_name("t")).first()[0] == "strasse a"


def test_snippet_centres_on_the_first_term(spark):
    body = "x" * 50 + " " * 3 + "a " * 200 + "needle" + " b" * 300
    got = one(spark, T.snippet(F.lit(body), T.any_of(["needle"])))
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) == 362
    assert one(spark, T.snippet(F.lit("short"), T.any_of(["zzz"]))) == "short"


def test_ocr_reason(spark):
    assert one(spark, T.ocr_reason(F.lit("few"))) == "low_text"
    assert one(spark, T.ocr_reason(F.lit("" * 10 + "a" * 20))) == "high_pua"
    assert one(spark, T.ocr_reason(F.lit("\x01" * 3 + "a" * 27))) == "high_control"
    assert one(spark, T.ocr_reason(F.lit("�" * 3 + "a" * 27))) == "high_replacement"
    assert one(spark, T.ocr_reason(F.lit("a" * 30))) is None


def test_quality_is_bounded(spark):
    assert one(spark, T.extraction_quality(F.lit(""))) == 0.0
    assert one(spark, T.extraction_quality(F.lit("가" * 2000))) == pytest.approx(1.0)
    assert one(spark, T.extraction_quality(F.lit("a" * 2000), -5)) == pytest.approx(0.7)


def test_embedding_text(spark):
    assert one(spark, T.embedding_text(F.lit("t"), F.lit("body"), 100)) == "t\nbody"
    got = one(spark, T.embedding_text(F.lit("t"), F.lit("b" * 500), 100))
    assert len(got) == 100 and "\n…\n" in got


def test_term_cap_keeps_the_longest_in_order(spark):
    assert one(spark, T.capped_terms(T.any_of(["aa", "b", "cccc", "aa", "ddd"]), 3)) == ["aa", "cccc", "ddd"]


def candidates(spark, docs, query):
    c = spark.createDataFrame([(1, i, d) for i, d in enumerate(docs)], "query_id int, index int, document string")
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    return [(r["index"], r["score"]) for r in lexical.bm25_rerank(c, q).orderBy("rank").collect()]


def test_bm25_rerank_formula(spark):
    docs = ["alpha alpha beta", "beta gamma", "delta", "alpha gamma gamma gamma gamma gamma"]
    got = dict(candidates(spark, docs, "alpha beta alpha"))
    toks = [d.split() for d in docs]
    avg = sum(map(len, toks)) / 4
    for i, t in enumerate(toks):
        want = 0.0
        for term in ("alpha", "beta"):
            df, tf = sum(term in x for x in toks), t.count(term)
            want += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_bm25_rerank_without_match_keeps_order(spark):
    assert candidates(spark, ["x", "y", "z"], "nothing") == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_rrf_order(spark):
    rows = [("lexical", 1, "a", 1), ("lexical", 1, "b", 2), ("vector", 1, "b", 1), ("vector", 1, "c", 2)]
    got = rank.rrf(spark.createDataFrame(rows, "channel string, query_id int, unit_id string, rank int")).orderBy("rank").collect()
    assert [r["unit_id"] for r in got] == ["b", "a", "c"]


def walk(hits, cap, limit):
    taken, over, seen = [], [], {}
    for unit, doc in hits:
        key = doc if doc is not None else f"unit:{unit}"
        if seen.get(key, 0) < cap:
            seen[key] = seen.get(key, 0) + 1
            taken.append((unit, False))
            if len(taken) == limit:
                return taken
        else:
            over.append((unit, True))
    return (taken + over)[:limit]


def test_diversity_equals_the_walk(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for q in range(60):
        hits = [(u, rnd.choice([None, 1, 2, 3])) for u in range(rnd.randint(0, 12))]
        rows += [(q, u, d, n + 1) for n, (u, d) in enumerate(hits)]
        want[q] = walk(hits, 2, 6)
    got = {}
    for r in rank.diversify(spark.createDataFrame(rows, "query_id int, unit_id int, document_id int, rank int"), 2, 6).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["unit_id"], r["diversity_backfill"]))
    assert got == {q: w for q, w in want.items() if w}


def test_pack_equals_the_loop(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for q in range(40):
        left = 5000
        for n in range(rnd.randint(1, 9)):
            size = rnd.choice([0, 10, 900, 3000])
            take = min(size, 1000, left)
            want[q, n] = (take, size > min(1000, left))
            left -= take
            rows.append((q, n, n + 1, size))
    got = rank.pack(spark.createDataFrame(rows, "query_id int, unit_id int, rank int, n_chars int"), 5000, 10, floor=1000).collect()
    assert {(r["query_id"], r["unit_id"]): (r["taken"], r["truncated"]) for r in got} == want


def test_abstains_only_if_all_terms_are_unknown(spark):
    q = spark.createDataFrame([(1, "foo bar"), (2, "foo known"), (3, "?")], "query_id int, query string")
    df = spark.createDataFrame([("known", 3), ("foo", 0)], "term string, df int")
    assert [r[0] for r in rank.abstained(q, df).collect()] == [1]


def test_cosine_of_nothing_is_zero(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id int, embedding array<float>")
    got = {r["vec_id"]: r["score"] for r in vector.cosine_topk(e, spark.createDataFrame([(9, [1.0, 1.0])], "query_id int, q array<float>"), 5).collect()}
    assert got == {1: 0.0, 2: pytest.approx(2**-0.5, abs=1e-6)}


def test_hidden_rows_stay_hidden(spark):
    u = spark.createDataFrame([(1, []), (2, ["a"]), (3, ["a", "b"]), (4, None)], "unit_id int, acl_scopes array<string>")
    assert sorted(r[0] for r in visible(u, ["a"]).select("unit_id").collect()) == [1, 2]
    ev = spark.createDataFrame([(10, 1), (10, 3), (11, 1)], "candidate int, unit_id int")
    c = spark.createDataFrame([(10,), (11,), (12,)], "candidate int")
    assert sorted(r[0] for r in fully_evidenced(c, "candidate", ev, visible(u, ["a"])).collect()) == [11, 12]


def test_paths_are_simple_and_capped(spark):
    edges = [(str(i), a, "p", b, "accepted", None, None) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "d")])]
    e = spark.createDataFrame(edges, "id string, subject_id string, predicate string, object_id string, status string, valid_from timestamp, valid_to timestamp")
    got = graph.paths(e, spark.createDataFrame([("a", "d")], "start_id string, end_id string")).orderBy("position").collect()
    assert [r["nodes"] for r in got] == [["a", "c", "d"], ["a", "b", "c", "d"]]


def test_predicate_diff(spark):
    s = "predicate string, domain array<string>, risk string, inverse string"
    b = spark.createDataFrame([("p", ["x", "y"], "low", None), ("q", ["x"], "low", None)], s)
    a = spark.createDataFrame([("p", ["x"], "high", "r"), ("n", ["x"], "low", None)], s)
    got = {(r[0], r[1]) for r in graph.predicate_diff(b, a).collect()}
    assert got == {("p", "domain_narrowed"), ("p", "risk_changed"), ("p", "predicate_semantics_changed"), ("q", "predicate_removed"), ("n", "predicate_added")}


def test_migration(spark):
    changes = spark.createDataFrame([("a", "breaking"), ("b", "breaking"), ("c", "compatible")], "symbol string, classification string")
    mapping = spark.createDataFrame([("a", "a2")], "symbol string, target string")
    assert [r[0] for r in graph.uncovered(changes, mapping).collect()] == ["b"]
    e = spark.createDataFrame([("1", "s", "a", "o")], "id string, subject_id string, predicate string, object_id string")
    assert graph.migrated(e, mapping).first()["predicate"] == "a2"


def test_review_fold_and_alias_conflicts(spark):
    ev = spark.createDataFrame([(1, 1, 0, "proposed"), (1, 2, 0, "approved"), (1, 2, 1, "revoked")], "id int, at int, seq int, status string")
    assert graph.folded(ev).first()["status"] == "revoked"
    al = spark.createDataFrame([(1, "Acme"), (2, "acme"), (3, "b")], "entity_id int, alias string")
    assert [r["alias"] for r in graph.alias_conflicts(al).collect()] == ["acme"]


def test_changed_files(spark):
    s = "path string, size int, mtime_ns int, sha256 string"
    state = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x")], s)
    scan = spark.createDataFrame([("a", 1, 1, "?"), ("b", 1, 2, "x"), ("c", 2, 2, "y"), ("d", 1, 1, "z")], s)
    assert {r[0]: r[1] for r in ingest.changed_files(scan, state).collect()} == {"a": "unchanged", "b": "touched", "c": "replaced", "d": "inserted"}


def test_metrics_without_expectations(spark):
    cases = spark.createDataFrame([(1, [], ["f"]), (2, ["a", "b"], ["f"]), (3, [], [])], "case_id int, expected array<string>, forbidden array<string>")
    run = spark.createDataFrame([(1, "f", 1), (2, "x", 1), (2, "a", 2), (2, "a", 3), (2, "f", 4)], "case_id int, document_id string, rank int")
    got = {r["case_id"]: r for r in evaluate.case_metrics(cases, run).collect()}
    assert (got[1]["recall"], got[1]["reciprocal_rank"], got[1]["unauthorized"]) == (1.0, 0.0, 1)
    assert (got[2]["recall"], got[2]["reciprocal_rank"]) == (0.5, 0.5)
    assert got[2]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[3]["reciprocal_rank"], got[3]["zero_results"]) == (1.0, True)


def test_portable_suite(spark):
    d = spark.range(20).select(F.col("id").cast("string").alias("id"), F.col("id").alias("document_id"), F.struct(*[F.lit(k).alias(k) for k in evaluate.QUESTION_KINDS]).alias("questions"))
    c = evaluate.portable_cases(d)
    assert c.count() == 120 and c.where("denied").count() == 20


def plain_adequacy(query, rows):
    """The cascade for one question, step by step; rows: (body, locator, partial, document, asserted, stale)."""
    from quernstone.functions.text import PARTICLES, QUESTION_WORDS

    def words(text):
        out = set()
        for w in re.findall(r"[0-9A-Za-z가-힣]{2,}", text.lower()):
            cut = next((p for p in PARTICLES if w.endswith(p) and len(w) - len(p) >= 2), "")
            w = w[: len(w) - len(cut)]
            if w not in QUESTION_WORDS:
                out.add(w)
        return out

    keys, only = words(query), lambda t: "".join(ch for ch in t.lower() if ch.isalnum())
    numeric = any(w in query for w in answer.NUMERIC_INTENT)
    left = [r for r in rows if r[4] or sum(k in r[0].lower() for k in keys) >= min(2, len(keys))]
    if numeric and any(r[1] == "xlsx_sheet" for r in left):
        return "exact_xlsx_read_required", 0
    if numeric and any(r[1] == "csv_rows" and r[2] for r in left):
        return "csv_full_table_required", 0
    ids = [m.group() for m in re.finditer(answer.IDENTIFIER, query)]
    focus = set()
    if "의" in query:
        focus = {t for t in words(query.rsplit("의", 1)[1]) if t not in answer.GENERIC_TERMS + answer.ASKING_TERMS and not t.endswith(answer.ASKING_ENDINGS)}
    gates = [lambda r: all(only(i) in only(r[0]) for i in ids), lambda r: all(t in r[0].lower() for t in focus), lambda r: not numeric or re.search(answer.VALUE, r[0])]
    for gate in gates:
        kept = [r for r in left if gate(r)]
        if left and not kept:
            return "answer_not_present", 0
        left = kept
    if len({r[3] for r in left}) > 1 and (not keys - set(answer.GENERIC_TERMS) or not ids and len(keys) <= 2):
        return "clarification_required", 0
    if "승인" in query and left:
        score = lambda r: sum(k in r[0].lower() for k in keys if not k.startswith(answer.DECISION_PREFIXES))
        top = max(map(score, left))
        left = [r for r in left if score(r) == top] if top else left
        if not any(re.search(answer.APPROVAL, r[0]) for r in left):
            return "insufficient_decision_evidence", 0
    if not left:
        return ("no_fresh_evidence" if any(r[5] for r in rows) else "no_admissible_evidence"), 0
    return None, len(left)


def test_adequacy_against_a_plain_cascade(spark):
    from quernstone.plans.store import ASKED, BODIES

    rnd = random.Random(4)
    rows, want = [], {}
    for q in range(400):
        query = rnd.choice([*ASKED, "계약 얼마", "변경계약의 승인 상태", "절차", "금액 AB-12 얼마인가"])
        own = [(rnd.choice(BODIES), rnd.choice(["text"] * 6 + ["csv_rows", "xlsx_sheet"]), rnd.random() < 0.5, rnd.randrange(2), rnd.random() < 0.1, rnd.random() < 0.3) for _ in range(rnd.randint(1, 4))]
        want[q] = plain_adequacy(query, own)
        rows += [(q, query, n, "", *r) for n, r in enumerate(own)]
    s = "query_id int, query string, unit_id int, title string, body string, locator_type string, partial boolean, document_id int, asserted boolean, stale boolean"
    got = {r["query_id"]: (r["refusal"], r["n_evidence"]) for r in answer.adequacy(spark.createDataFrame(rows, s)).collect()}
    assert got == want and len({r for r, _ in want.values()}) >= 7


def test_locators_are_held_key_by_key(spark):
    rows = [('{"a":{"b":1,"c":[1,2]},"d":"x"}', e) for e in ('[{"a":{"b":1}}]', '[{"a":{"c":[1,2]}}]', '[{"a":{"c":[1]}}]', '[{"z":1},{"d":"x"}]', "[]", '[{"a":{"b":2}}]', '[{"d":["x"]}]')] + [(None, "[{}]")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, e string").select(evaluate.locator_matches("a", "e")).collect()]
    assert got == [True, True, False, True, False, False, False, False]


def test_gates_of_unknown_values_do_not_pass(spark):
    one = spark.createDataFrame([(200, None, 1.0, 0, 0, 5.0)], "cases int, recall double, mrr double, failed int, unauthorized int, p95_ms double")
    got = {r["gate"]: r["passed"] for r in evaluate.portable_gate(one).collect()}
    assert got["recall"] is False and got["promote"] is False and got["cases"]
    v = "variant string, recall double, unauthorized int, failed int, p95_ms double, metrics array<double>, fingerprint string, expected_fingerprint string"
    rows = [(x, 0.9, 0, 0, 10.0, [1.0], "f", "f") for x in ("a", "b", "b")]  # a variant twice makes no second row
    c = spark.createDataFrame([("a", "k", 0.5), ("b", "k", 0.5)], "variant string, category string, recall double")
    assert {r["gate"]: r["passed"] for r in evaluate.recommendation(spark.createDataFrame(rows, v), c, "a", "b", ["k"]).collect()}["promote"]
    assert not {r["gate"]: r["passed"] for r in evaluate.recommendation(spark.createDataFrame(rows, v), c, "a", "b", ["k", "l"]).collect()}["promote"]


def test_rendered_blocks(spark):
    from quernstone.operators import content

    rows = [('{"text":"","content":"c"}',), ('{"rows":[[{"text":"a"},{"text":"b"}],[{"text":"c"}]]}',), ('{"imageData":{}}',), ("not json",), (None,)]
    got = [r["body"] for r in content.rendered(spark.createDataFrame(rows, "block string")).collect()]
    assert got == ["c", "a\tb\nc", "[image: unnamed]", "", ""]


def test_batches_by_length(spark):
    from quernstone.operators import content

    d = spark.createDataFrame([("x" * (i * 37 % 101),) for i in range(100)], "body string")
    parts = content.by_length(d, parts=3).select(F.spark_partition_id().alias("p"), F.length("body").alias("n")).collect()
    by = {}
    for r in parts:
        by.setdefault(r["p"], []).append(r["n"])
    assert all(v == sorted(v) for v in by.values()) and len(parts) == 100


def test_one_workspace(spark):
    from quernstone.operators import content

    d = spark.createDataFrame([("a", 1), ("b", 2)], "workspace_id string, x int")
    assert [r["x"] for r in content.in_workspace(d, "b").collect()] == [2]


def test_normal_forms(spark):
    texts = ["  a\tb\x00c \x1f d ", "ｆｕｌｌ　ＷＩＤＴＨ", "Straße", "", None, "Ünï \x85 x", "PLAIN ascii\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_text("t").alias("a"), T.normalize_name("t").alias("b")).orderBy("i").collect()
    import unicodedata

    for t, r in zip(texts, got, strict=True):
        assert r["a"] == (None if t is None else " ".join(unicodedata.normalize("NFKC", t.replace("\x00", " ")).split()))
        if t is None or "\x00" not in t:
            assert r["b"] == (None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def test_whole_bodies_are_searched(spark):
    u = spark.createDataFrame([(1, "filler " * 3000 + "needle"), (2, "filler")], "unit_id int, body string")
    q = spark.createDataFrame([(1, "needle")], "query_id int, query string")
    assert [r["unit_id"] for r in lexical.bm25(u, q, 5).collect()] == [1]


def test_paths_through_hubs(spark):
    e = spark.createDataFrame([("h%d" % i, f"x{i}", "hub") for i in range(50)] + [("a", "start", "hub"), ("b", "hub", "mid"), ("c", "mid", "end"), ("d", "start", "end")], "id string, subject_id string, object_id string")
    pairs = spark.createDataFrame([("start", "end")], "start_id string, end_id string")
    got = [r["edge_ids"] for r in graph.paths(e, pairs, 3).orderBy("position").collect()]
    assert got == [["d"], ["a", "b", "c"]] and graph.paths(e, pairs, 2).count() == 1


def test_fuzzy(spark):
    assert fuzzy.similarity("green tea", "tea green") == 1.0
    assert fuzzy.similarity("", "x") == 0.0
    assert fuzzy.indel("abcd", "abxd") == pytest.approx(0.75)
    c = spark.createDataFrame([(1, 0, "unrelated words"), (1, 1, "annual report 2024")], "query_id int, index int, document string")
    q = spark.createDataFrame([(1, "annual report")], "query_id int, query string")
    assert fuzzy.fuzzy_rerank(c, q).orderBy("rank").first()["index"] == 1


def test_fuzzy_reads_whole_texts(spark, monkeypatch):
    filler = "filler " * 3000
    assert fuzzy.similarity("annual report", filler + "report annual") == 1.0
    c = spark.createDataFrame([(1, 0, filler), (1, 1, filler + "annual report")], "query_id int, index int, document string")
    q = spark.createDataFrame([(1, "annual report")], "query_id int, query string")
    assert fuzzy.fuzzy_rerank(c, q).orderBy("rank").first()["index"] == 1
    # against the plain table of prefixes, with any number of places at a time
    rnd = random.Random(5)
    for bits in (1, 3, 8, 1 << 14):
        monkeypatch.setattr(fuzzy, "BITS", bits)
        for _ in range(50):
            a, b = ("".join(rnd.choice("ab 가😀") for _ in range(rnd.randrange(25))) for _ in range(2))
            best = {}
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i, j] = best.get((i - 1, j - 1), 0) + 1 if x == y else max(best.get((i - 1, j), 0), best.get((i, j - 1), 0))
            assert fuzzy.common(a, b) == best.get((len(a) - 1, len(b) - 1), 0)


def test_latest_with_ties(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 5, "a"), (1, dt.datetime(2024, 1, 1), 6, "b"), (2, None, 1, "c")]
    got = {r[0]: r[1] for r in ingest.latest(spark.createDataFrame(rows, "k int, at timestamp, tie int, v string"), "k", "at", "tie", "v").collect()}
    assert got == {1: "b", 2: "c"}


def test_large_query_sets_meet_rows_in_blocks(spark, monkeypatch):
    from quernstone.operators import blocks

    e = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id int, q array<float>")
    key = lambda r: (r["query_id"], r["rank"])
    want = sorted(vector.cosine_topk(e, q, 4).collect(), key=key)
    monkeypatch.setattr(vector, "BOUND", 3)  # no matrix of all queries
    assert sorted(vector.cosine_topk(e, q, 4).collect(), key=key) == want
    monkeypatch.setattr(blocks, "BOUND", 3)
    assert sorted(vector.cosine_topk(e, q, 4).collect(), key=key) == want


def test_cosine_of_odd_vectors(spark):
    e = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [3.0])], "query_id string, q array<float>")
    got = [(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in vector.cosine_topk(e, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [("a", 1, 1.0, 1), ("a", 3, 1.0, 2), ("b", 1, 0.0, 1), ("b", 2, 0.0, 2), ("d", 4, 1.0, 1)]


def test_aliases_anywhere_in_queries(spark):
    q = spark.createDataFrame([(1, "Orders of Acme Corp"), (2, "xacme corp")], "query_id int, query string")
    a = spark.createDataFrame([(7, "acme corp"), (8, "corp"), (9, "")], "entity_id int, alias string")
    found = lambda f: {(r["query_id"], r["entity_id"]): (r["position"], r["longest"]) for r in f(q, a).collect()}
    assert found(rank.resolve) == {(1, 7): (11, 9), (1, 8): (16, 4), (2, 7): (2, 9), (2, 8): (7, 4)}


def test_expansion_meets_aliases_that_begin_or_end_inside_words(spark):
    q = spark.createDataFrame([(1, "Frances wines"), (2, "서울에서 온 편지"), (3, "xacme corp"), (4, "c++ code")], "query_id int, query string")
    a = spark.createDataFrame([(1, "France"), (2, "서울"), (3, "acme"), (4, "++")], "entity_id int, alias string")
    n = spark.createDataFrame([(1, "Gaul"), (2, "Seoul"), (3, "Acme Inc"), (4, "plus")], "entity_id int, name string")
    got = {r["query_id"]: r["expansions"] for r in rank.expand(q, a, n).collect()}
    assert got == {1: ["Gaul"], 2: ["Seoul"], 3: ["Acme Inc"], 4: ["plus"]}


def test_context_keeps_fully_accepted_paths(spark):
    from quernstone.operators import records

    p = spark.createDataFrame([("a", "b", ["1", "2"]), ("a", "c", ["2", "3"]), ("a", "d", ["2", "4"])], "start_id string, end_id string, edge_ids array<string>")
    e = spark.createDataFrame([(1, "accepted", True), (2, "accepted", True), (3, "proposed", True), (4, "accepted", None)], "id int, status string, fresh boolean")
    assert [r["end_id"] for r in records.context_paths(p, e).collect()] == ["b"]


def test_search_modes(spark):
    from quernstone.operators.search import Search

    u = spark.createDataFrame([(1, 1, "red apple"), (2, 1, "green pear"), (3, 2, "red pear")], "unit_id int, document_id int, body string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(1, "red", [0.0, 1.0]), (2, "pear", None), (3, "?!", [1.0, 0.0])], "query_id int, query string, q array<float>")
    rows = Search(u, v).run(q).collect()
    assert {(r["query_id"], r["degraded"]) for r in rows} == {(1, False), (2, True)} and {r["mode"] for r in rows} == {"hybrid"}
    assert {r["mode"] for r in Search(u).run(q).collect()} == {"lexical"}
    assert Search(u, v).run(q, mode="reranked").count() == Search(u, v).run(q, mode="hybrid").count()
    with pytest.raises(ValueError):
        Search(u).run(q, mode="vector")
    with pytest.raises(ValueError):
        Search(u).run(q, limit=0)


def test_contradictions_against_all_pairs(spark):
    rnd, day = random.Random(3), lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = []
    for i in range(160):
        start = rnd.choice([None, *range(0, 400, 7)] if i % 9 == 0 else range(0, 400, 7))
        end = None if i % 11 == 0 else (start or 0) + rnd.choice([0, 1, 7, 30, 300, -5])
        rows.append((i, f"s{i % 3}", "p", f"o{rnd.randrange(4)}", start, end))
    before = lambda end, start: end is not None and start is not None and end <= start
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] != b[3] and not before(a[5], b[4]) and not before(b[5], a[4])}
    df = spark.createDataFrame([(*r[:4], day(r[4]), day(r[5])) for r in rows], "id long, subject_id string, predicate string, object_id string, valid_from timestamp, valid_to timestamp")
    got = [tuple(r) for r in graph.contradictions(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.contradictions(df.where("false")).count() == 0
