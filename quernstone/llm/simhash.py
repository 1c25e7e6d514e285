"""SimHash near-duplicates: fingerprints of whole texts, linked by tiled exact comparison.

Distinct fingerprints are compared tile by tile: exclusive or and bit counts in numpy, tile pairs whose population counts differ beyond the
radius being skipped. Only fingerprints with an equal block of bits share tiles; with more blocks than differing bits every link has one, so
the comparison stays exact. Links join fingerprints, not rows, and a component is named by the least doc_id of all its rows.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; fewer
words than a shingle give one shingle of them all; repeated rows keep a row each; a row without doc_id has a
fingerprint, links and bridges like any other, and gets its component's least doc_id (null if no row of it has one); very long texts are read
in pieces. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import connected, durable, hex64

SEED = 42
#: Shingles whose bits are spread out at a time: bounds memory on very long texts.
PIECE = 16_384
#: Fingerprints in a tile of the exact comparison.
TILE = 256
#: Rows of one block value are dealt into sqrt(rows) / SPREAD parts.
SPREAD = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a whole text, as a signed 64-bit word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    a, b = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, PIECE):
        spans = list(zip(a[k : k + PIECE], b[k : k + PIECE], strict=True))
        h = np.array([digest(joined[x:y], SEED) for x, y in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def close(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of a and b (of a itself without b) that differ in radius bits or fewer, tile by tile."""
    own = b is None
    b = a if own else b
    count = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int32)
    pa_, pb = count(a), count(b)
    oa = np.argsort(pa_, kind="stable")
    ob = oa if own else np.argsort(pb, kind="stable")
    a, b, pa_, pb = a[oa], b[ob], pa_[oa].astype(int), pb[ob].astype(int)
    left, right = [], []
    for i in range(0, len(a), TILE):
        x = a[i : i + TILE]
        lo, hi = pa_[i], pa_[min(i + TILE, len(a)) - 1]
        for j in range(i if own else 0, len(b), TILE):
            if pb[j] > hi + radius:
                break
            if pb[min(j + TILE, len(b)) - 1] < lo - radius:
                continue
            y = b[j : j + TILE]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for w in range(1, a.shape[1]):
                apart = apart + np.bitwise_count(x[:, None, w] ^ y[None, :, w]).astype(np.uint16)
            r, c = np.nonzero(apart <= radius)
            left.append(oa[r + i])
            right.append(ob[c + j])
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node linked to it) of the graph on ``ids`` with links i-j."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    i, j, lab = rank[i], rank[j], np.arange(len(ids))
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    moved = np.nonzero(lab != np.arange(len(ids)))[0]
    sorted_ids = ids[order]
    return sorted_ids[moved], sorted_ids[lab[moved]]


def links(fps: DataFrame, radius: int = 4, blocks: int = 5) -> DataFrame:
    """(u, v) links that connect what lies within ``radius`` bits; fps: distinct fingerprints ``fp``, longs.

    With more blocks than differing bits, two linked fingerprints agree on a block: only those
    with an equal block are compared. A block value with n of them is dealt into about sqrt(n)/SPREAD parts, and each pair of parts is a task's
    row of its own, so that neither a common value nor a large group meets in one place. From a pair of parts
    comes a spanning forest, never all its pairs.
    """
    if blocks <= radius:
        raise ValueError("links are complete only with more blocks than differing bits")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    value = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    rows = fps.select("fp", F.explode(F.array(*value)).alias("k")).select("fp", "k.block", "k.value")
    # most values have few rows and aren't listed: the list is short, and Spark broadcasts it only if it is small
    parts = durable(rows.groupBy("block", "value").agg(F.ceil(F.sqrt(F.count("*")) / SPREAD).cast("int").alias("parts")).where("parts > 1"))
    dealt = (
        rows.join(parts, ["block", "value"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")})
    )
    own = F.col("p") == F.col("i")
    tiles = dealt.groupBy("block", "value", "i", "j").agg(F.collect_list(F.when(own, F.col("fp"))).alias("a"), F.collect_list(F.when(~own, F.col("fp"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, na), (bt, nb) = ((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns)
            us, vs = [], []
            for k in range(batch.num_rows):
                a, b = na[at[k] : at[k + 1]], nb[bt[k] : bt[k + 1]]
                if len(b) == 0 and len(a) < 2:
                    continue
                i, j = close(a.view(np.uint64)[:, None], b.view(np.uint64)[:, None] if len(b) else None, radius)
                if len(i):
                    u, v = forest(np.concatenate((a, b)), i, j + len(a) * (len(b) > 0))
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    return tiles.select("a", "b").mapInArrow(run, "u long, v long")


def simhash(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 5) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text)."""
    marked = durable(fingerprints(docs, shingle))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(nodes.select("fp"), radius, blocks))
    classes = durable(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
