"""SimHash near-duplicates, verified: groups of documents that share 0.8 of their shingles of five words.

Documents with the same set of shingles are one node, with a SimHash fingerprint of 256 bits of that set. Fingerprints are compared tile
by tile (exclusive or and bit counts, tile pairs whose population counts differ beyond RADIUS being skipped), and what differs in RADIUS bits or fewer
becomes a link if the Jaccard similarity of the two sets, from the whole texts, is SHARE or more. Groups are the components of the links.

Tiles hold nodes that share a block. Blocks of equal bits, as in ``simhash``, lose pairs at this radius: with 24 of them 1 in 100 pairs at 0.8.
A block is therefore an equal band of MinHash values of the shingles, BANDS bands of ROWS: a pair at 0.8 shares none with a probability
of 0.59 ** 16 = 0.0002, at 0.85 of 0.000005. Two fingerprints at 0.8 differ in 38 bits on average (deviation 6; at worst in 48, sets of four and
five shingles), so more than RADIUS are a matter of one in a million (there: of three in ten thousand).

Pairs are looked at in two rounds, so that a group of n copies doesn't make n * n of them. First each block's nodes are
chained, each with the next. What these links don't connect is compared in full: of each block whose
nodes are in several groups, all pairs between groups, tile by tile; sets of up to SMALL shingles lie beside their fingerprints there, so that
only what will be a link is looked up again.

Defined cases: words are as in simhash; a null text is empty, and texts without words are one group; fewer words than a
shingle give one shingle of them all; rows without doc_id take no part; rows of one doc_id with different
texts are judged apart; repeated rows are in one group; very long texts are read in pieces; an empty table gives an empty result. Columns
other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import connected, durable
from quernstone.llm.simhash import close

SHINGLE, SHARE = 5, 0.8
BANDS, ROWS = 16, 4
WORDS64, RADIUS = 4, 68
#: Shingles whose minima are taken at a time: bounds memory on very long texts.
PIECE = 4096
#: Shingles of a set that is carried with its fingerprint, at most: larger ones are few, and looked up.
SMALL = 4096
#: Nodes of one band value are dealt into sqrt(nodes) / SPREAD parts.
SPREAD = 16

_rng = np.random.default_rng(42)
SALT = _rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
ODD = _rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
LANES = _rng.integers(0, 2**64, WORDS64, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text, by 64-bit hash, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[x:y]) for x, y in spans), np.uint64, n))


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(h), PIECE):
        x = (h[None, a : a + PIECE] ^ SALT) * ODD
        x ^= x >> np.uint64(29)
        x *= MIX
        np.minimum(out, x.min(1), out=out)
    return out


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes: a bit is 1 if it is set in over half of them. Each lane of 64 bits remixes the hashes."""
    votes = np.zeros(64 * WORDS64, np.int64)
    for a in range(0, len(h), PIECE):
        x = h[a : a + PIECE, None] ^ LANES
        for shift in (30, 27):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    v = np.arange(BANDS, dtype=np.uint64)
    for c in least.reshape(BANDS, ROWS).T:
        v = (v ^ c) * MIX
        v ^= v >> np.uint64(29)
    return v.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def row_key() -> Column:
    """What tells rows apart: also different texts under one doc_id."""
    return F.xxhash64("doc_id", "text")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, k, node (the set's hash), bands, fp (the set's fingerprint), size (of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, values, fps, sizes = [], [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py())
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                values.append(bands(minima(h)) if len(h) else np.empty(0, np.int64))
                fps.append(fingerprint(h))
                sizes.append(len(h))
            cols = [b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in (values, fps)), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "node", "bands", "fp", "size"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k long, node long, bands array<long>, fp array<long>, size int")


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (node, t, v) of band values that several nodes have, with parts: how many a value's nodes are dealt into, and p: the node's own."""
    common = durable(rows.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v", F.ceil(F.sqrt("n") / SPREAD).cast("int").alias("parts")))
    return rows.join(common, "v").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _next(lists: DataFrame) -> DataFrame:
    """(u, v) of neighbours in the ascending lists ``a``."""
    a = F.col("a")
    pairs = lists.where("size(a) > 1").select(F.explode(F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 1).alias("u"), F.slice(a, F.lit(2), F.size(a) - 1).alias("v"))).alias("e"))
    return pairs.select("e.u", "e.v")


def _chained(rows: DataFrame) -> DataFrame:
    lists = rows.groupBy("v", "p").agg(F.sort_array(F.collect_list("node")).alias("a"), F.max("parts").alias("parts")).where("parts > 1 or size(a) > 1")
    lists = durable(lists)
    heads = lists.where("parts > 1").groupBy("v").agg(F.sort_array(F.collect_list(F.col("a")[0])).alias("a"))
    return _next(lists).unionByName(_next(heads)).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """(node, own): 32 bits of each shingle hash of a set, ascending; null for sets of more than SMALL. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            own = [None if len(h) > SMALL else np.unique(h.astype(np.uint32)).view(np.int32) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], names=["node", "own"])

    return texts.select("node", "text").mapInArrow(run, "node long, own array<int>")


def _alike(a: list, b: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the similarity of the sets a[i] and b[j] may be SHARE or more; a, b: sets of 32 bits of hash, or None for unknown."""
    out = np.ones(len(i), bool)
    known = np.array([x is not None for x in b], bool)[j] if len(j) else out
    order = np.argsort(i, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(i[order]))[0] + 1) if len(i) else ():
        rows = rows[known[rows]]
        x = a[i[rows[0]]] if len(rows) else None
        if x is None or not len(x):
            continue
        others = [b[k] for k in j[rows]]
        sizes = np.fromiter(map(len, others), np.int64, len(others))
        flat = np.concatenate(others)
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        both = np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=hit, minlength=len(rows))
        # equal halves of different hashes only add to the similarity
        out[rows] = both >= SHARE * (len(x) + sizes - both) - 1e-9
    return out


def _between(rows: DataFrame) -> DataFrame:
    """(u, v) of rows (t, v, parts, p, node, bands, fp, size, own, label) with an equal band t, none before, different labels, fingerprints within
    RADIUS, and sets that are alike as far as they are known."""
    dealt = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")})
    row = F.struct("node", "label", "size", "fp", "bands", "own")
    tiles = dealt.groupBy("t", "v", "i", "j").agg(F.collect_list(F.when(F.col("p") == F.col("i"), row)).alias("a"), F.collect_list(F.when(F.col("p") != F.col("i"), row)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(col: pa.Array, k: int) -> tuple:
            v = col.values.slice(col.offsets[k].as_py(), col.offsets[k + 1].as_py() - col.offsets[k].as_py())
            plain = [v.field(x).to_numpy(zero_copy_only=False) for x in ("node", "label", "size")]
            own = v.field("own")
            at, hashes, null = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False).view(np.uint32), own.is_null().to_numpy(zero_copy_only=False)
            sets = [None if null[x] else hashes[at[x] : at[x + 1]] for x in range(len(v))]
            wide = [v.field(x).flatten().to_numpy(zero_copy_only=False).reshape(len(v), n) for x, n in (("fp", WORDS64), ("bands", BANDS))]
            return *plain, wide[0].view(np.uint64), wide[1], sets

        for batch in batches:
            for k, t in enumerate(batch.column(0).to_pylist()):
                na, la, sa, fa, ba, xa = flat(batch.column(1), k)
                other = flat(batch.column(2), k)
                own = not len(other[0])
                nb, lb, sb, fb, bb, xb = (na, la, sa, fa, ba, xa) if own else other
                i, j = close(fa, None if own else fb, RADIUS)
                x, y = sa[i], sb[j]
                keep = (la[i] != lb[j]) & (np.minimum(x, y) >= SHARE * np.maximum(x, y))
                i, j = i[keep], j[keep]
                # a pair is looked at in the first of its bands
                keep = ~(ba[i, :t] == bb[j, :t]).any(1)
                i, j = i[keep], j[keep]
                keep = _alike(xa, xb, i, j)
                u, v = na[i[keep]], nb[j[keep]]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], names=["u", "v"])

    return tiles.select("t", "a", "b").mapInArrow(run, "u long, v long").distinct()


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose fingerprints differ in RADIUS bits or fewer, and whose sizes allow for SHARE."""
    u, v = (nodes.select(F.col("node").alias(c), F.col("fp").alias(f"f{c}"), F.col("size").alias(f"n{c}")) for c in "uv")
    apart = sum((F.bit_count(F.col("fu")[k].bitwiseXOR(F.col("fv")[k])) for k in range(WORDS64)), F.lit(0))
    return pairs.join(u, "u").join(v, "v").where((apart <= RADIUS) & (F.least("nu", "nv") >= SHARE * F.greatest("nu", "nv"))).select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of SHARE or more; texts: (node, text), one for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [jaccard(shingle_set(x.as_py()), shingle_set(y.as_py())) >= SHARE for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, k (see row_key), root of each row with doc_id: rows of one group have the same root."""
    marked = durable(_marked(docs))
    nodes = durable(marked.groupBy("node").agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("bands", "fp", "size")]))
    rows = durable(_shared(nodes.select("node", F.posexplode("bands").alias("t", "v"))))
    # all texts that any comparison reads: one exchange of the documents, the same one at every size
    wanted = durable(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.col("k").alias("tk")))
    keyed = docs.where("doc_id is not null").select(row_key().alias("tk"), F.col("text").cast("string").alias("text"))
    texts = durable(keyed.join(wanted.hint("merge"), "tk").dropDuplicates(["tk"]).select("node", "text"))

    close_by = durable(_near(durable(_chained(rows)), nodes))
    links = durable(_verified(close_by, texts))
    roots = durable(connected(links))
    labelled = durable(rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    open_values = durable(labelled.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v"))
    met = durable(labelled.join(open_values, "v"))
    sets = durable(_sets(texts.join(met.select("node").distinct(), "node", "left_semi")))
    between = met.join(nodes.select("node", "bands", "fp", "size"), "node").join(sets, "node")
    more = durable(_verified(durable(_between(between).join(close_by, ["u", "v"], "left_anti")), texts))
    roots = durable(connected(links.unionByName(more)))
    return marked.join(roots, "node", "left").select("doc_id", "k", F.coalesce("root", "node").alias("root"))
