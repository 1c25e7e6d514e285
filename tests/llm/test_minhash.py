"""MinHash near-duplicates against all pairs of sets."""

import random

import numpy as np
import pytest

from quernstone.llm import minhash
from quernstone.llm.minhash import BINS, _across, buckets, near_duplicates, shingle_set, signature

S = "doc_id long, text string, node string, bands int, kept double"  # extra columns with clashing names


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate({i: " " for i in range(9, 14)}).split(" ") if x]
    return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def run(spark, rows):
    got = near_duplicates(spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], S).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed=2, families=30):
    """Families of edited copies around the limit: stars alone leave some of their links."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeÉß") for _ in range(rnd.randint(2, 6)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([1, 2, 5, 9, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 7)):
            near = list(base)
            for _ in range(max(1, len(base) * rnd.choice([2, 4, 6, 8]) // 100)):
                near[rnd.randrange(len(near))] = word()
            texts.append(" ".join(near).upper() if rnd.random() < 0.2 else "\t".join(near))
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[0]), (None, None), (1, ""), (2, None), (3, " \n"), (4, "solo"), (5, "SOLO"), (None, "lone one"), (rows[5][0], rows[5][1]), (rows[6][0], "other words altogether"), (8, texts[3] + " \x0b")]


def test_against_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_exact_join_alone(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_star", lambda rows, order: rows.selectExpr("node AS u", "node AS v").where("false"))
    rows = corpus(4, 20)
    assert run(spark, rows) == plain(rows)


def test_group_around_the_limit(spark):
    """One bucketful of copies, whose pairs lie on both sides of the limit, and many copies of one text."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for k in rnd.sample(range(60), 3):
            own[k] = f"n{i}_{k}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(base[:50])) for i in range(200, 320)]
    assert run(spark, rows) == plain(rows)


def test_all_pairs_at_the_limit_share_a_bucket():
    rng = np.random.default_rng(5)
    for n in (4, 8, 40, 400, 3000):
        for _ in range(100):
            x = rng.integers(0, 2**63, n + n // 4, dtype=np.int64).view(np.uint64)
            cut = n // 8  # n of n + n // 4 shingles are shared
            a, b = np.sort(x[: n + cut]), np.sort(np.concatenate((x[:n], x[n + cut :])))
            assert (buckets(signature(a)) == buckets(signature(b))).any()


def test_bins_agree_as_sets_do():
    rng = np.random.default_rng(6)
    for n in (10, 100, 2000):
        agree = []
        for _ in range(150):
            x = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
            agree.append((signature(np.sort(x[: 3 * n // 4])) == signature(np.sort(x[n // 4 :]))).mean())
        assert abs(np.mean(agree) - 0.5) < 0.03
    assert len(signature(np.array([7], np.uint64))) == BINS


def test_pairs_across_components():
    rng = np.random.default_rng(7)
    for own in (True, False):
        a, b = (np.column_stack((np.arange(n) + at, rng.choice([1, 1, 1, 2, 3], n), rng.integers(40, 60, n), rng.integers(0, 12, n))) for n, at in ((300, 0), (170, 1000)))
        u, v = _across(a, None if own else b)
        want = set()
        for x in a.tolist():
            for y in (a if own else b).tolist():
                if x[1] != y[1] and 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2]) and 180 * min(x[2] - x[3], y[2] - y[3]) >= 80 * (x[2] + y[2]):
                    want.add((min(x[0], y[0]), max(x[0], y[0])))
        assert set(zip(u.tolist(), v.tolist(), strict=True)) == want and want


def test_of_none_and_of_one_long_text(spark):
    assert run(spark, []) == []
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(200_000))
    rows = [(1, long), (2, long + " and"), (3, "and")]
    got = run(spark, rows)
    assert [r[2] for r in got] == [1, 1, 3] and got[0][1] == len(plain_set(long)) == len(shingle_set(long.encode()))
