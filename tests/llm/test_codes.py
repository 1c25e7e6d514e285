"""Vector codes against a plain restatement; the trees against all distances."""

import hashlib

import numpy as np
import pytest

from quernstone.llm.codes import codes, nearest, tree

S = "vec_id long, embedding array<float>, label int, code int, error string"  # extra columns with clashing names


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest of each usable row, by Python's whole numbers."""
    held = lambda x: max(-(2**63), min(2**63 - 1, int(np.floor(float(np.float32(x)) * 256))))
    rows = [(i, [held(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max(len(v) for _, v, _ in rows)
    width = max(1, -(-dim // parts))
    cut = lambda v: [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)]
    first = {}
    for i, v, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x, p: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        found = [[pick(x, p) for p, x in enumerate(cut(v))] for _, v, _ in rows]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(rows, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v, label in rows:
        f = [pick(x, p) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for k in f), min(2**63 - 1, sum(dist(x, books[p][k]) for p, (x, k) in enumerate(zip(cut(v), f, strict=True)))), label))
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(2**63 - 1, total[label]), sha) for i, c, e, label in out), key=str)


def run(spark, rows, parts=3):
    got = codes(spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], S).repartition(parts))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("width,spread", [(1, 4), (2, 3), (4, 1000), (5, 2), (3, 1)])
def test_nearest_against_all_distances(kind, width, spread):
    rng = np.random.default_rng(width * spread)
    entries, points = (rng.integers(0, spread, (n, width)).astype(kind) for n in (64, 300))
    found, d = nearest(tree(entries), entries, points)
    all_ = ((points[:, None] - entries[None]) ** 2).sum(2).astype(np.int64)
    assert (found == all_.argmin(1)).all() and (d.astype(np.int64) == all_.min(1)).all()


def test_codes_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 32).astype(np.float32)], [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(i, [0.25] * 32, 1) for i in range(300, 360)]  # one very common vector
    rows += [rows[3], (7, rows[9][1], 1), (None, rows[5][1], None), (401, None, 1), (402, [None] * 32, 1), (403, [float("nan")] * 32, 1), (404, [float("-inf")] * 32, 2), (405, [1.0] * 5, 2), (406, [], 2)]
    assert run(spark, rows) == plain(rows)


def test_components_beyond_doubles_whole_numbers(spark):
    rows = [(0, [1e30, -1e30] * 8, 1), (1, [3e8, 5.0] * 8, 1), (2, [1e12] * 16, None), (3, [-2e12] * 16, None), (4, [0.5] * 16, 1)]
    assert run(spark, rows) == plain(rows)


def test_codes_of_few_of_none_and_without_labels(spark):
    rows = [(5, [0.1, 0.2, 0.3], 1), (9, [0.3, 0.1, 0.0], 1)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == run(spark, [(1, None, 1)]) == run(spark, [(None, [1.0], 1)]) == []
    bare = codes(spark.createDataFrame([(1, [0.5]), (2, [0.7])], "vec_id long, embedding array<double>"))
    assert [r["label_error"] for r in bare.collect()] == [0, 0]
