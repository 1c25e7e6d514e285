"""SimHash and the pipeline's use of it."""

import random

import numpy as np
import pytest
import xxhash

from quernstone.llm import near_copies
from quernstone.llm.simhash import close, fingerprint, forest, links, simhash

S = "doc_id long, text string, fp string, node int"  # extra columns with clashing names


def plain(text, shingle=4):
    """A restatement bit by bit."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    own = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, radius=4):
    """Smallest doc_id reachable, by repeated sweeps over all pairs."""
    ids = {i: i for i in range(len(fps))}
    moved = True
    while moved:
        moved = False
        for i in ids:
            for j in ids:
                if bin(fps[i] ^ fps[j]).count("1") <= radius and ids[j] < ids[i]:
                    ids[i], moved = ids[j], True
    return ids


def corpus():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeÉß") for _ in range(rnd.randint(1, 6)))
    out = []
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            near = list(base)
            near[rnd.randrange(len(near))] = word()
            out.append(" ".join(near).upper() if rnd.random() < 0.2 else "\t".join(near))
    return [*out, "", "  \n", "one two", "One TWO", "one\x0btwo three"]


@pytest.mark.parametrize("text", ["", None, " \t", "a", "A b", "a b c d", "a b c d e f g", "Ünï ÉA b\x0cc\x0bd e", "a b c d e", "x " * 50_000])
def test_fingerprint(text):
    if text and len(text) > 1000:
        assert fingerprint(text) & (2**64 - 1) == xxhash.xxh64_intdigest(b"x x x x", 42)
    else:
        assert fingerprint(text) & (2**64 - 1) == plain(text)


def test_close_pairs_are_all_found():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (700, 1), dtype=np.uint64)
    a[350:] = a[:350] ^ (np.uint64(1) << rng.integers(0, 63, (350, 1), dtype=np.uint64))
    for b in (None, a[:333]):
        y = a if b is None else b
        got = {(int(i), int(j)) for i, j in zip(*close(a, b, 4), strict=True)}
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None, 0] ^ y[None, :, 0]) <= 4), strict=True)}
        assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want} if b is None else got == want


def test_forest_connects():
    u, v = forest(np.array([50, 10, 30, 20, 40]), np.array([0, 2, 3]), np.array([2, 4, 3]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {50: 30, 40: 30}


def test_against_all_pairs(spark):
    texts = corpus()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = simhash(spark.createDataFrame(rows, S).repartition(5)).collect()
    fps = [plain(t) for t in texts]
    want = classes(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in enumerate(fps)}


def test_large_groups_meet_in_parts(spark):
    # one block value for all: thousands of fingerprints, dealt into parts
    from quernstone.llm.common import connected
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 2**63, 1500) & ~np.int64(0x1FFF))
    near = [int(f) ^ (1 << 40) for f in fps[:700]]
    rows = [(int(f),) for f in [*fps, *near]]
    got = {r["node"]: r["root"] for r in connected(links(spark.createDataFrame(rows, "fp long"))).collect()}
    of = lambda f: got.get(f, f)
    assert all(of(int(f)) == of(g) for f, g in zip(fps, near))
    assert len({of(f) for (f,) in rows}) > 700
    with pytest.raises(ValueError):
        links(spark.createDataFrame(rows, "fp long"), radius=5, blocks=5)


def test_tiles_of_unlike_population_counts_are_skipped(monkeypatch):
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (seen.append(x.shape), count(x))[1])
    a = np.concatenate((np.zeros(600, np.uint64), np.full(600, 2**64 - 1, np.uint64)))[:, None]
    close(a, None, 4)
    # of the 15 pairs of five tiles the four of low with high counts aren't looked at
    assert 0 < sum(len(s) == 2 and s[0] > 1 and s[1] > 1 for s in seen) <= 11


def test_nulls_repeats_and_none(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(None, "a b c d e", None, None), (7, "a b c d e", None, None), (7, "a b c d e", None, None), (8, None, None, None), (9, "", None, None), (None, "zz yy xx", None, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash(spark.createDataFrame(rows, S)).collect()), key=str)
    assert [(a, b) for a, b, _ in got] == [(7, 7), (7, 7), (8, 8), (9, 8), (None, 7), (None, None)] and got[2][2] == "0" * 16
    assert simhash(spark.createDataFrame([], S)).count() == 0
    # a row without doc_id bridges: each edit moves the fingerprint a little
    words, chain = base.split(), []
    for k in range(12):
        words[7 * k] = f"x{k}"
        chain.append((None if k % 2 else k, " ".join(words), None, None))
    want = classes([plain(t) for _, t, *_ in chain])
    got = {r["fingerprint"]: r["component_id"] for r in simhash(spark.createDataFrame(chain, S)).collect()}
    members = {}
    for i, root in want.items():
        members.setdefault(root, []).append(i)
    for own in members.values():
        ids = [i for i in own if i % 2 == 0]
        assert {got[f"{plain(chain[i][1]):016x}"] for i in own} == {min(ids) if ids else None}


def test_the_wide_fingerprint_keeps_pairs_within_its_radius():
    rng = np.random.default_rng(5)
    far = []
    for _ in range(2000):
        n = int(rng.integers(45, 400))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = a.copy()
        # the least similarity that counts: both sets lose and gain
        k = int(n / 9)
        b[:k] = rng.integers(0, 2**64, k, dtype=np.uint64)
        both = len(np.intersect1d(a, b))
        assert both / (2 * n - both) >= 0.8
        x, y = near_copies.fingerprint(a), near_copies.fingerprint(b)
        far.append(int(np.bitwise_count((x ^ y).view(np.uint64)).sum()))
    assert max(far) <= near_copies.RADIUS and np.mean(far) < 45
    some = [near_copies.fingerprint(rng.integers(0, 2**64, 50, dtype=np.uint64)) for _ in range(300)]
    unlike = [int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) for x, y in zip(some, some[1:], strict=False)]
    assert min(unlike) > near_copies.RADIUS


def shingles_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stage_against_brute_force(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**5)}"
    rows = [(None, "no id", "", 0), (900, "", "", 0), (901, None, "", 0), (902, "a b", "", 0), (903, "A  b", "", 0)]
    for i in range(80):
        base = [word() for _ in range(rnd.randint(5, 300))]
        rows.append((10 * i, " ".join(base), "", 0))
        for c in range(1, 4):
            # edits around the limit: each changes up to five shingles; copies of copies make chains
            own = list(base)
            for k in rnd.sample(range(len(own)), max(1, int(len(own) * rnd.choice([0.01, 0.02, 0.025, 0.03, 0.045])))):
                own[k] = word()
            rows.append((10 * i + c, " ".join(own), "", 0))
            base = own if rnd.random() < 0.3 else base
    rows += [(0, " ".join(word() for _ in range(50)), "", 0), rows[5]]  # doc_id 0 again with a text of its own, and as it is
    sets = [shingles_of(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    between = 0
    for i in range(1, len(rows)):
        for j in range(1, i):
            both = len(sets[i] & sets[j])
            all_ = len(sets[i] | sets[j])
            between += 0.6 <= (both / all_ if all_ else 1) < 0.8
            if (both / all_ if all_ else 1) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(1, len(rows)):
        groups.setdefault(find(i), []).append(rows[i][:2])
    want = sorted([min(g, key=lambda r: r[0])[0] for g in groups.values()])
    got = [r["doc_id"] for r in corpus_pipeline.single(spark, spark.createDataFrame(rows, S).repartition(3), "").collect()]
    assert between > 20 and sorted(x for x in got if x is not None) == want and got.count(None) == 1


def test_pairs_at_the_limit_are_found(spark):
    # 300 pairs of one similarity just above 0.8: each found but with a calculated probability of 0.0002
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        base = [f"v{i}x{k}" for k in range(rnd.randint(50, 250))]
        own, n = list(base), len(base) - 4
        # an edit at the start of every stretch of five changes five shingles
        for k in range(int(n / 9) // 5):
            own[4 + 9 * k] = "edited"
        assert near_copies.jaccard(near_copies.shingle_set(" ".join(base)), near_copies.shingle_set(" ".join(own))) >= 0.8
        rows += [(2 * i, " ".join(base), "", 0), (2 * i + 1, " ".join(own), "", 0)]
    got = {r["doc_id"]: r["root"] for r in near_copies.near_copies(spark.createDataFrame(rows, S)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) >= 298
    assert near_copies.near_copies(spark.createDataFrame([], S)).count() == 0


def test_simhash_of_long_texts_among_columns_of_the_same_names(spark):
    rnd = random.Random(12)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(40_000))  # several pieces of shingles
    rows = [(1, long, "x", 1, 2.0, "y"), (2, long + " z", "x", 1, 2.0, "y"), (3, "a b c d e", "x", 1, 2.0, "y"), (4, None, None, None, None, None)]
    got = {r["doc_id"]: r for r in simhash(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int, fp double, node string")).collect()}
    assert got[1]["fingerprint"] == f"{plain(long):016x}" and got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert got[4]["fingerprint"] == "0" * 16
