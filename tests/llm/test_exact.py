"""Operators with exact results: decontamination, top-k, repeats, mixing; and passages."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from quernstone.llm import decontaminate, mixing, passages, repeats, topk

DOC = "doc_id long, text string, source string, k long, n int, w string"


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], DOC).repartition(parts)


def words(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def shingle_set(text, m=5):
    w = [x for x in re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip().split(" ") if x]
    return {" ".join(w[i : i + m]) for i in range(max(1, len(w) - m + 1))} if w else set()


def test_decontaminate_against_sets(spark):
    rnd = random.Random(1)
    items = [(i, " ".join(words(rnd, rnd.choice([1, 3, 5, 12, 40, 90])))) for i in range(30)] + [(None, "w1 w2"), (90, None), (91, " , ")]
    rows = [(None, "x", "s"), (900, None, "s"), (901, "", "s")]
    for i in range(120):
        w = words(rnd, rnd.choice([2, 30, 400]))
        if i % 3 == 0:
            own = items[rnd.randrange(30)][1].upper().split()
            for k in rnd.sample(range(len(own)), len(own) // rnd.choice([8, 15, 100])):
                own[k] = "zz"
            at = rnd.randrange(len(w))
            w[at:at] = own
        rows.append((i, ", ".join(w), "s"))
    rows.append(rows[-1])
    got = decontaminate.report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        # an item of fewer words than five is sought at its own length
        want = []
        for i, t in items:
            m = min(5, len((t or "").split()))
            s = shingle_set(t)
            if i is not None and s and len(s & shingle_set(texts[r["doc_id"]], m)) >= 0.8 * len(s) - 1e-9:
                want.append(i)
        want.sort()
        assert r["item_ids"] == want and r["contaminated"] == bool(want), r["doc_id"]
    kept = decontaminate.clean(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert kept.count() == sum(not r["contaminated"] for r in got)


def test_short_items_in_long_texts(spark):
    items = spark.createDataFrame([(1, "The secret answer is"), (2, "forty two"), (3, "is"), (4, "secret the answer is")], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "we know that the secret, ANSWER is surely not out there now", "s"), (2, long + " the secret answer is", "s"), (3, "two forty", "s"), (4, "forty-two", "s")]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.report(docs(spark, rows), items).collect()}
    assert got == {1: [1, 3], 2: [1, 3], 3: [], 4: [2]}


def test_decontaminate_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, [(1, "a b c d e f", "s")])
    assert not decontaminate.report(d, none).first()["contaminated"] and decontaminate.clean(d, none).count() == 1
    assert decontaminate.report(d.where("false"), none).count() == 0


def nearest(rows, k=5):
    out = []
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    for q in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_against_all_pairs(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(0, 0.3, (6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] + rnd.normal(0, 0.05, 8)).astype(np.float32)]) for i in range(700)]
    rows += [(i, [0.25] * 8) for i in range(700, 1100)]  # one very common vector
    rows += [(1150, None), (1200, [1.0, None]), (1250, [float("nan")] * 8), (None, [1.0] * 8), (1300, []), (1350, [2.0]), (1351, [float("inf")])]
    e = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(7)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.topk(e).collect())
    assert got == nearest(rows)


def test_topk_of_few_and_of_none(spark):
    s = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1e30, -1e30])]
    # the query again is still itself; another row again is a candidate again
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.topk(spark.createDataFrame([*rows, rows[0], rows[1]], s)).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1), (0, 3, 1)]
    empty = topk.topk(spark.createDataFrame([(0, []), (3, []), (2, []), (50, None)], s)).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in empty] == [(0, 2, 0), (0, 3, 0)]
    assert topk.topk(spark.createDataFrame([], s)).count() == 0
    assert topk.topk(spark.createDataFrame([(0, [1.0])], s)).count() == 0


def test_tight_groups_go_to_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 24))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + rng.normal(0, 0.01, (60, 24)) for c in centres])
    rows = [(i, [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x[rng.permutation(len(x))])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.copies(e, every=10) < 6  # of 12 cells and more
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.topk(e).collect())
    assert got == nearest(rows)


def cut_plainly(texts, depth=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        mark = np.zeros(len(r) + 1, int)
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                mark[i] += 1
                mark[i + depth] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_all_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)  # runs over edges of segments
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab é\n") for _ in range(700)) for _ in range(6)]
    texts = [None, "", "a" * 3000, "a" * 300, "ab" * 400, "x" * 199, "y" * 200, "y" * 200, "é" * 150]
    for _ in range(60):
        t = ""
        for _ in range(rnd.randint(1, 5)):
            i = rnd.randint(0, 600)
            t += rnd.choice(base)[i : i + rnd.randint(50, 500)] + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        texts.append(t)
    texts.append(texts[-1])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.cut(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == cut_plainly(texts)


def test_repeats_of_rows_alike(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(250))
    got = repeats.cut(docs(spark, [(1, t, "s"), (1, t, "s"), (None, t, "s"), (2, "short", "s")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 250), ("1", 250), ("2", 0), ("None", 250)]
    assert repeats.cut(spark.createDataFrame([], DOC)).count() == 0


def test_chains_follow_order_and_gaps():
    segs = sorted([[0, 20, 100, 120, 3], [25, 45, 126, 146, 3], [50, 70, 10, 30, 3], [75, 95, 180, 200, 3]])
    best = passages.chains(segs)
    assert best[0] == [0, 1, 3] and [2] in best
    assert passages.common_words(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2


def test_a_long_segment_far_away_hides_no_neighbour():
    assert [1, 2] in passages.chains([[0, 500, 0, 500, 60], [600, 630, 600, 630, 3], [632, 662, 632, 662, 3]])
    rnd = random.Random(6)
    for _ in range(300):
        segs = sorted([d, d + n, r, r + n, 2] for d, r, n in ((rnd.randrange(300), rnd.randrange(300), rnd.randint(8, 60)) for _ in range(rnd.randint(2, 14))))
        score = []
        for d0, d1, r0, _, _ in segs:
            near = [score[j] - passages.GAP_COST * (d0 - s[1] + r0 - s[3]) for j, s in enumerate(segs[: len(score)]) if 0 <= d0 - s[1] <= passages.MAX_GAP and 0 <= r0 - s[3] <= passages.MAX_GAP]
            score.append(d1 - d0 + max([0.0, *near]))
        best = passages.chains(segs)[0]
        own = [segs[i] for i in best]
        total = sum(s[1] - s[0] for s in own) - sum(passages.GAP_COST * (y[0] - x[1] + y[2] - x[3]) for x, y in zip(own, own[1:]))
        assert abs(total - max(score)) < 1e-6


def test_words_between_seeds_are_compared():
    # four seeds of 8 words, 16 words apart: what lies between isn't taken for alike
    a, b = np.arange(80), np.arange(80)
    b[[k for k in range(80) if k % 24 >= 8]] += 1000
    out, same = passages.aligned([a], [b], [[[0, 80, 0, 80, 4]]])
    assert not out.any() and same[0] == 32


def test_ends_are_drawn_out_over_words_that_differ():
    a = np.arange(100)
    b = a.copy()
    b[[10, 20, 27, 71, 75]] += 500
    b[:5] += 500
    out, same = passages.aligned([a], [b], [[[40, 60, 40, 60, 3]]])
    assert (out[:, 0].tolist(), same[0]) == ([35, 40, 35, 40], 95 - 5)
    # the beginning of a text is no match
    out, _ = passages.aligned([a[:60]], [a[10:60]], [[[40, 60, 30, 50, 3]]])
    assert out[:, 0].tolist() == [30, 0, 30, 0]
    # three words that only one side has
    out, same = passages.aligned([np.concatenate((a[:70], a[:3], a[70:]))], [a], [[[40, 60, 40, 60, 3]]])
    assert (out[:, 0].tolist(), same[0]) == ([40, 43, 40, 40], 100)


def longest_passage(a, b):
    """By the plain rule: the best local alignment's span, 1 for a word that agrees, -2 for others and gaps."""
    best, spans = 0, 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    start = {}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d, u, v = h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), h[i - 1, j] - 2, h[i, j - 1] - 2
            h[i, j] = max(0, d, u, v)
            if h[i, j]:
                start[i, j] = start.get({d: (i - 1, j - 1), u: (i - 1, j), v: (i, j - 1)}[h[i, j]], (i - 1, j - 1))
            if h[i, j] > best:
                best, spans = h[i, j], i - start[i, j][0]
    return spans


def found_alone(a, b):
    (ha, aa), (hb, bb) = passages.seeds(a.view(np.uint64)), passages.seeds(b.view(np.uint64))
    at = dict(zip(ha.tolist(), aa.tolist(), strict=True))
    m = np.array([(at[h], i) for h, i in zip(hb.tolist(), bb.tolist(), strict=True) if h in at]).reshape(-1, 2)
    segs = passages.segments(m[:, 0], m[:, 1]) if len(m) else []
    for chain in passages.chains(segs) if segs else []:
        own = [segs[i] for i in chain]
        if sum(s[4] for s in own) > 1:
            x, y = max(0, own[0][0] - passages.FLANK), max(0, own[0][2] - passages.FLANK)
            out, same = passages.aligned([a[x : own[-1][1] + passages.FLANK]], [b[y : own[-1][3] + passages.FLANK]], [[[s[0] - x, s[1] - x, s[2] - y, s[3] - y, s[4]] for s in own]])
            n = own[-1][1] - own[0][0] + out[0, 0] + out[1, 0]
            if n >= passages.MIN_WORDS and same[0] / n >= passages.IDENTITY:
                return True
    return False


@pytest.mark.parametrize(("n", "edits", "least"), [(52, 0.0, 0.98), (52, 0.05, 0.95), (60, 0.0, 0.98), (60, 0.05, 0.98), (60, 0.1, 0.95), (60, 0.15, 0.9), (100, 0.1, 0.98), (100, 0.15, 0.95), (100, 0.18, 0.95), (200, 0.15, 0.98), (200, 0.18, 0.98)])
def test_recall_of_edited_passages(n, edits, least):
    rng = np.random.default_rng(n)
    new = lambda k: rng.integers(1, 2**62, k)
    got = tried = 0
    for _ in range(150):
        p = new(n)
        q = p.copy()
        at = rng.choice(n, int(n * edits), replace=False)
        q[at] = new(len(at))
        if edits and rng.random() < 0.3:
            k = int(rng.integers(15, n - 15))
            q = np.concatenate((q[:k], new(2), q[k:]))  # two words put in
        tried += 1
        got += found_alone(np.concatenate((new(70), p, new(70))), np.concatenate((new(70), q, new(70))))
    assert got >= least * tried, got / tried


def test_found_passages_against_a_plain_alignment(spark):
    rnd = random.Random(7)
    shared = [words(rnd, rnd.randint(30, 120), 10**6) for _ in range(6)]
    rows = []
    for i in range(24):
        own = list(rnd.choice(shared))
        for k in rnd.sample(range(len(own)), int(len(own) * rnd.choice([0, 0.03, 0.08]))):
            own[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words(rnd, rnd.randint(5, 40), 10**6) + own + words(rnd, rnd.randint(5, 40), 10**6)), "s"))
    pairs = {(r["doc_id"], r["other_doc_id"]) for r in passages.passages(docs(spark, rows)).collect()}
    h = [passages.word_hashes(t) for _, t, _ in rows]
    spans = {(i, j): longest_passage(h[i].tolist(), h[j].tolist()) for i in range(24) for j in range(i)}
    # what is reported is there, either way round, and every document that shares a passage clearly over the limit has a partner
    assert all((j, i) in pairs and spans[max(i, j), min(i, j)] >= 45 for i, j in pairs)
    sure = {x for (i, j), n in spans.items() if n >= 56 for x in (i, j)}
    assert sure and sure <= {i for i, _ in pairs}


def test_passages_of_frequent_parts_are_found(spark):
    # A and B share 60 words, whose halves also stand alone in many other documents
    rnd = random.Random(9)
    left, right = words(rnd, 30, 10**6), words(rnd, 30, 10**6)
    rows = [(i, " ".join(words(rnd, 60, 10**6) + (left if i % 2 else right) + words(rnd, 60, 10**6)), "s") for i in range(6)]
    rows += [(i, " ".join(words(rnd, 40, 10**6) + left + right + words(rnd, 40, 10**6)), "s") for i in range(100, 120)]
    got = {r["doc_id"] for r in passages.passages(docs(spark, rows)).collect()}
    assert got == set(range(100, 120))


def test_passages_of_one_word_over_and_over_are_found(spark):
    rnd = random.Random(11)
    rows = [(10 * w + i, " ".join(words(rnd, rnd.randint(5, 30), 10**6) + [f"w{w}"] * (60 + 7 * i) + words(rnd, 30, 10**6)), "s") for w in range(12) for i in range(3)]
    # a line of seven words as well
    line = words(rnd, 7, 10**6)
    rows += [(500 + i, " ".join(words(rnd, 20, 10**6) + line * (9 + i)), "s") for i in range(2)]
    got = {(r["doc_id"], r["other_doc_id"]) for r in passages.passages(docs(spark, rows)).collect()}
    assert got == {(i, j) for i, _, _ in rows for j, _, _ in rows if i != j and i // 10 == j // 10}


def test_all_pairs_of_a_passage_in_few_documents_are_given(spark):
    rnd = random.Random(12)
    shared = words(rnd, 60, 10**6)
    rows = [(i, " ".join(words(rnd, 30, 10**6) + shared + words(rnd, 30, 10**6)), "s") for i in range(9)]
    # others that have a part of it stand between them
    rows += [(100 + i, " ".join(words(rnd, 40, 10**6) + shared[10 * i : 10 * i + 10]), "s") for i in range(6)]
    got = {(r["doc_id"], r["other_doc_id"]) for r in passages.passages(docs(spark, rows)).collect()}
    assert got == {(i, j) for i in range(9) for j in range(9) if i != j}


def test_very_common_seeds_go_to_buckets(spark, monkeypatch):
    monkeypatch.setattr(passages, "BUCKET", 10)
    monkeypatch.setattr(passages, "RANGES", 3)
    rnd = random.Random(10)
    shared = words(rnd, 70, 10**6)
    rows = [(i, " ".join(words(rnd, 20, 10**6) + shared + words(rnd, 20, 10**6)), "s") for i in range(90)]
    got = passages.passages(docs(spark, rows)).toPandas()
    assert set(got.doc_id) == set(range(90)) and len(got) <= 90 * 6
    root = list(range(90))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in zip(got.doc_id, got.other_doc_id, strict=True):
        root[find(i)] = find(j)
    assert len({find(i) for i in range(90)}) == 1


def test_passages(spark):
    rnd = random.Random(5)
    shared = words(rnd, 80, 10**6)
    fuzzy_copy = list(shared)
    for k in (20, 45, 61):
        fuzzy_copy[k] = "edited"
    rows = [(i, " ".join(words(rnd, 150, 10**6)), "s") for i in range(30)]
    rows += [(100, " ".join(words(rnd, 60, 10**6) + shared + words(rnd, 60, 10**6)), "s"), (101, " ".join(words(rnd, 40, 10**6) + [w.upper() for w in shared]), "s"), (102, " ".join(fuzzy_copy + words(rnd, 9, 10**6)), "s")]
    rows += [(None, " ".join(shared), "s"), (103, None, "s"), (104, "", "s"), (105, "the " * 3000, "s"), (rows[0][0], rows[0][1], "s")]
    got = passages.passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {r["other_doc_id"] for r in got} == {100, 101, 102}
    assert all(r["end"] - r["start"] >= 78 and r["identity"] >= 0.9 for r in got)
    assert passages.passages(spark.createDataFrame([], DOC)).count() == 0


def fill_plainly(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """Repeated sharing: what is over a cap goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[n % 3] for n, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while free and total > 1e-9:
        unit = total / sum(w[s] for s in free)
        full = {s for s in free if w[s] * unit >= epochs * sizes[s]}
        for s in full or free:
            out[s] = epochs * sizes[s] if full else w[s] * unit
            total -= out[s]
        free -= full or free
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        s = rnd.choice([None, "a", "b", "Z", "é", "empty"] + ["hot"] * 5)
        rows.append((i if i % 50 else None, None if s == "empty" or i % 37 == 0 else " \t".join(words(rnd, rnd.randint(0, 30))) + ("\n" if i % 2 else ""), s))
    rows += rows[:3]
    got = mixing.mix(docs(spark, rows)).toPandas()
    again = mixing.mix(docs(spark, rows, 9)).toPandas()
    key = ["doc_id", "size", "taken", "target"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(round(x, 6) for x in set(got.target)) == sorted({round(x, 6) for x in fill_plainly(sizes).values()})
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all() and len(got) == len(rows)
    for (target, _), g in got.groupby(["target", "source_size"]):
        assert abs(g.taken.sum() - target * len(g.groupby("source_size")) ) <= 2 or target == 0
    con = duckdb.connect()
    frame = docs(spark, rows).toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    sql = con.sql(mixing.ORACLE).df()
    assert sorted(zip(sql["size"], sql.taken, strict=True)) == sorted(zip(got["size"], got.taken, strict=True))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).agg({"taken": "sum"}).first()[0] == 0


def test_bounds_of_large_items_leave_most_shingles_out(spark):
    rnd = random.Random(4)
    item = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(400)))], "item_id long, text string")
    d = docs(spark, [(i, " ".join(words(rnd, 600, 5000)), "s") for i in range(30)] + [(99, " ".join(words(rnd, 50)), "s")])
    r = decontaminate.searched(d, item).first()
    assert r["shingles"] == 30 * 596 + 46 and 0 < r["searched"] < 0.4 * r["shingles"]
    plan = decontaminate.contaminated(d, item)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "w#" in line for line in plan.split("\n"))


@pytest.mark.parametrize(("n", "edits"), [(60, 0.1), (60, 0.15), (100, 0.18)])
def test_recall_of_the_operator(spark, n, edits):
    """Pairs of documents with an edited passage, all in one table: the operator itself, neighbours and all."""
    rnd, rows = random.Random(n), []
    for i in range(40):
        p = words(rnd, n, 10**7)
        q = list(p)
        for k in rnd.sample(range(n), int(n * edits)):
            q[k] = f"e{i}x{k}"
        rows += [(2 * i + s, " ".join(words(rnd, 60, 10**7) + own + words(rnd, 60, 10**7)), "s") for s, own in enumerate((p, q))]
    pairs = {(r["doc_id"], r["other_doc_id"]) for r in passages.passages(docs(spark, rows)).collect()}
    assert all(i // 2 == j // 2 for i, j in pairs)
    assert sum((2 * i, 2 * i + 1) in pairs for i in range(40)) >= 36


def test_topk_and_mix_among_columns_of_the_same_names(spark):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0], 9, "x", 1.0, i) for i in range(120)], "vec_id long, embedding array<float>, query_id int, v string, score double, rank int")
    bare = topk.topk(e.select("vec_id", "embedding")).collect()
    assert sorted(map(tuple, topk.topk(e).collect())) == sorted(map(tuple, bare))
    long = "w " * 200_000
    d = spark.createDataFrame([(i, long if i == 0 else "a b c", f"s{i % 2}", 1, 2.0, "z") for i in range(40)], "doc_id long, text string, source string, size int, taken double, target string")
    got = sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "taken").collect()))
    assert got == sorted(map(tuple, mixing.mix(d.select("doc_id", "text", "source")).select("doc_id", "size", "taken").collect())) and got[0][1] == 200_000
