"""Importance resampling against a plain restatement; chunks against whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quernstone.llm.resample import CHUNK, chunks, features, numbered, resample

S = "doc_id long, text string, score string, row int, weight double"  # extra columns with clashing names


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(rows, items, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda t: zlib.crc32(t.encode()) % buckets
    own = lambda text: [bucket(" ".join(w[i : i + m])) for w in [words(text)] for m in range(1, longest + 1) for i in range(len(w) - m + 1)]
    corpus, target = Counter(b for _, t in rows for b in own(t)), Counter(b for t in items for b in own(t))
    s_all, t_all = sum(corpus.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, own(t)))
        out.append([i, len(own(t)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(spark, rows, items, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], S).repartition(3)
    got = resample(docs, spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string"), **kw)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdÉßcd7") for _ in range(rnd.randint(1, 5)))
    vocabulary = [word() for _ in range(150)]
    rows = [(i, rnd.choice([" ", ", ", "\x00", "—"]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 19, 20, 60, 300])))) for i in range(260)]
    rows += [(i, rows[4][1]) for i in range(900, 960)]  # copies
    rows += [(None, rows[7][1].upper()), (None, None), (970, None), (971, ""), (972, " .,"), (973, "x"), rows[9], rows[9]]
    items = [" ".join(rnd.choice(vocabulary[:30]) for _ in range(20)) for _ in range(15)] + [None, ""]
    return rows, items


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_against_plain(spark, longest):
    rows, items = corpus()
    assert run(spark, rows, items, longest=longest) == plain(rows, items, longest=longest)


@pytest.mark.parametrize("longest", [1, 3])
def test_long_texts_are_cut_without_loss(spark, longest):
    rnd = random.Random(8)
    long = " ".join(rnd.choice(["alpha", "b", "gämma", "x" * 50]) for _ in range(60_000))
    rows = [(1, long), (2, "Z" * (3 * CHUNK) + " end"), (3, "alpha b " * 30), (4, long), (None, long[:-3])] + [(i, "alpha b c " * 10) for i in range(10, 40)]
    assert len(long.encode()) > 4 * CHUNK
    assert run(spark, rows, ["alpha b", "gämma b"], longest=longest) == plain(rows, ["alpha b", "gämma b"], longest=longest)


@pytest.mark.parametrize("longest", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 2, 7, 40, 1000])
def test_chunks_own_each_feature_once(longest, size):
    rnd = random.Random(size)
    text = "".join(rnd.choice("ab. É,") for _ in range(400)).encode()
    n, whole = features(text, len(text), longest)
    parts = [features(piece, own, longest) for piece, own in chunks(text, longest, size)]
    assert sum(p[0] for p in parts) == n
    assert sorted(np.concatenate([p[1] for p in parts]).tolist()) == sorted(whole.tolist())


def test_without_rows(spark):
    assert run(spark, [], ["a b"]) == [] and run(spark, [], []) == []
    rows = [(i, "w " * 25) for i in range(20)]
    assert run(spark, rows, []) == plain(rows, [])


def test_places_over_partitions(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS s").repartition(9)
    got, n = numbered(df, df["s"].desc(), df["id"].asc())
    want = {i: k + 1 for k, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 7), i)))}
    assert n == 5000 and {r["id"]: r["place"] for r in got.collect()} == want
