"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates, exact confirmation.

A document's set are its distinct shingles of two words. One hash of each shingle chooses a bin and a value; a bin keeps its least value,
and an empty bin takes over that of the first filled bin in a random order of its own (optimal densification), so that bins agree with the probability
of the sets' similarity, and independently of each other. BANDS bands of ROWS bins are buckets: of two documents with a similarity of 0.8 five in a million pairs
share none (0.738 ** 40), at 0.85 six in a thousand million.

Documents with the same set are one node. In a bucket every node is a candidate with the bucket's centre alone, a star, so that n nodes give
n - 1 pairs and not n * n. Pairs are confirmed on the full sets. A star misses links between nodes that aren't linked with its centre:
buckets whose nodes aren't all linked then get another centre, a different one in each bucket. What even these
leave in several components is joined exactly: sets of nodes in such buckets, in an order from rare to frequent shingles, must share one of the first
n - ceil(0.8 n) + 1 if their similarity is 0.8 or more (prefix filter), at places that leave room for enough others (positional filter). Pairs
within a component aren't looked at again, so no group is compared all with all because its members are alike.

Defined cases: a null text is empty; a document without words has an empty set and is linked with nothing; one word is a shingle of its own; a row without
doc_id has a set, links and bridges like any other and gets its component's least doc_id (null if no row of it has one; kept is false then); rows of
one doc_id with different texts are judged apart; repeated rows keep a row each, in one component; very long texts are read whole; an empty
table gives an empty result. Columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import connected, durable

#: Percent of the union that linked sets share.
SHARE = 80
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Shingles of the exact join are ordered by how often one with the same last bits occurs.
ORDER_BITS = 18
#: Nodes of one shingle are dealt into sqrt(nodes) / SPREAD parts; rows of a part that are compared at a time.
SPREAD, TILE = 16, 64

_rng = np.random.default_rng(7)
#: For each bin the order in which it looks for a filled one.
PROBE = np.argsort(_rng.random((BINS, BINS)), axis=1)
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xBF58476D1CE4E5B9)
EMPTY = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words that spreads each bit."""
    x = (x ^ (x >> np.uint64(30))) * FOLD
    x = (x ^ (x >> np.uint64(27))) * MIX
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles of two words of a whole text, by 64-bit hash, ascending."""
    words = (text or b"").lower().split()  # A-Z and ASCII spaces only
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) > 1:
        h = mixed(h[:-1]) * FOLD + h[1:]
    return np.unique(mixed(h))


def signature(h: np.ndarray) -> np.ndarray:
    """The least value of each bin of a set that isn't empty, by one permutation, densified."""
    x = mixed(h ^ MIX)
    at = ((x >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.intp)
    out = np.full(BINS, EMPTY)
    np.minimum.at(out, at, mixed(x))
    filled = np.zeros(BINS, bool)
    filled[at] = True
    gaps = np.nonzero(~filled)[0]
    if len(gaps):
        order = PROBE[gaps]
        out[gaps] = out[order[np.arange(len(gaps)), filled[order].argmax(1)]]
    return out


def buckets(values: np.ndarray) -> np.ndarray:
    """A hash for each band, its number included."""
    v = np.arange(BANDS, dtype=np.uint64)
    for c in values.reshape(BANDS, ROWS).T:
        v = mixed((v + MIX) ^ c)
    return v.view(np.int64)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").cast("binary").alias("text"))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, k, n (shingles), node (hash of the set), bands (null without shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, bands = [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py())
                sizes.append(len(h))
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                bands.append(buckets(signature(h)) if len(h) else None)
            cols = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "n", "node", "bands"])

    return _read(docs).mapInArrow(run, "doc_id long, k long, n long, node long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, own): the sets of ``wanted`` (node, k), from one exchange of the texts, the same one at every size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    found = _read(docs).select("k", "text").join(wanted.hint("merge"), "k").dropDuplicates(["k"])
    return found.select("node", "text").mapInArrow(run, "node long, own array<long>")


def _alike(a: str, b: str) -> Column:
    """Sizes that leave room for SHARE."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SHARE


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets share SHARE percent of their union."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    counted = both.select("u", "v", (F.size("a") + F.size("b")).alias("all"), same.alias("same"))
    return counted.where(F.col("same") * 100 >= (F.col("all") - F.col("same")) * SHARE).select("u", "v")


def _star(rows: DataFrame, order: Column) -> DataFrame:
    """(u, v): each node of ``rows`` (bucket, node, n, label) and the first of its bucket by ``order``, if they may be linked and aren't in one component."""
    # the centre's fields come from the bucket's least row by a partially aggregated minimum
    centre = durable(rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "n", "label")).alias("c")))
    met = rows.join(centre, "bucket").where(F.col("label") != F.col("c.label"))
    pairs = met.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v"), "n", F.col("c.n").alias("m"))
    return pairs.where(_alike("n", "m")).select("u", "v").distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles with the same last ORDER_BITS bits occur: a number for each such value, whatever the number of sets."""
    mask = (1 << ORDER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(mask + 1, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & mask, minlength=mask + 1)
        some = np.nonzero(n)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["at", "n"])

    out = np.zeros(mask + 1, np.int64)
    for r in sets.select("own").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _prefixes(sets: DataFrame) -> DataFrame:
    """(shingle, node, label, n, at): of each set (node, label, own) the rarest shingles, one of which any partner must share, and their places."""
    counts, mask = _frequencies(sets), (1 << ORDER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shingles, lengths = [], []
            for x in b.column(2):
                h = x.values.to_numpy(zero_copy_only=False)
                first = len(h) - -(-SHARE * len(h) // 100) + 1
                shingles.append(h[np.lexsort((h, counts[h & mask]))[:first]])
                lengths.append((len(h), len(shingles[-1])))
            sizes, n = np.array(lengths).reshape(-1, 2).T
            rows = np.repeat(np.arange(b.num_rows), n)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            if len(rows):
                pick = pa.array(rows)
                cols = [pa.array(np.concatenate(shingles)), b.column(0).take(pick), b.column(1).take(pick), pa.array(sizes[rows], pa.int64()), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["shingle", "node", "label", "n", "at"])

    return sets.select("node", "label", "own").mapInArrow(run, "shingle long, node long, label long, n long, at long")


def _across(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of pairs between the rows (node, label, n, at) of a and b (within a, without b) in different components that may share enough."""
    own = b is None
    b = a if own else b
    labels, counts = np.unique(np.concatenate((a[:, 1], b[:, 1])), return_counts=True)
    if len(labels) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    main = labels[counts.argmax()]  # the largest component's rows don't meet each other
    us, vs = [], []
    for x, y in ((a[a[:, 1] != main], b), (a[a[:, 1] == main], b[b[:, 1] != main])):
        for k in range(0, len(x), TILE):
            p = x[k : k + TILE, None, :]
            q = y[None, :, :]
            # from here on they can share no more
            room = np.minimum(p[..., 2] - p[..., 3], q[..., 2] - q[..., 3])
            enough = (p[..., 1] != q[..., 1]) & (np.minimum(p[..., 2], q[..., 2]) * 100 >= np.maximum(p[..., 2], q[..., 2]) * SHARE) & (room * (100 + SHARE) >= (p[..., 2] + q[..., 2]) * SHARE)
            i, j = np.nonzero(enough)
            us.append(x[i + k, 0])
            vs.append(y[j, 0])
        if own:
            break  # pairs with the largest component are among those of the others
    u, v = np.concatenate(us or [np.empty(0, np.int64)]), np.concatenate(vs or [np.empty(0, np.int64)])
    return np.minimum(u, v), np.maximum(u, v)


def _joined(rows: DataFrame) -> DataFrame:
    """(u, v) of prefix rows (shingle, node, label, n, at) with an equal shingle, in different components, that may be linked.

    A shingle's rows are dealt into about sqrt(n) / SPREAD parts, and each pair of parts is a row of its own, so that no frequent one meets in one place.
    """
    shared = rows.groupBy("shingle").agg(F.count("*").alias("many"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    shared = durable(shared.select("shingle", F.ceil(F.sqrt("many") / SPREAD).cast("int").alias("parts")))
    dealt = rows.join(shared, "shingle").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")})
    row = F.array("node", "label", "n", "at")
    tiles = dealt.groupBy("shingle", "i", "j").agg(F.collect_list(F.when(F.col("p") == F.col("i"), row)).alias("a"), F.collect_list(F.when(F.col("p") != F.col("i"), row)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(x: pa.ListScalar) -> np.ndarray:
            return x.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = rows_of(x), rows_of(y)
                u, v = _across(a, b if len(b) else None)
                if len(u):
                    pairs = np.unique(np.column_stack((u, v)), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return tiles.select("a", "b").mapInArrow(run, "u long, v long").distinct()


def _hops(links: DataFrame) -> DataFrame:
    """(node, root): the least node within two links, by two aggregations: nodes of one root are in one component, though not all of a component have one root."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = durable(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("root")))
    return near.join(near.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.least("root", "far").alias("root"))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, n, label) of ``rows`` in buckets whose nodes have several roots; label: the root of each."""
    named = durable(rows.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("label")))
    several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return durable(named.join(durable(several), "bucket", "left_semi"))


def classes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes (node, k, n, bands) that are linked with another; root: the same for one component."""
    each = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    rows = durable(each.join(durable(shared), "bucket", "left_semi"))
    sets = durable(_sets(docs, nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "k")))

    met = durable(_star(rows.withColumn("label", F.col("node")), F.col("node")))
    links = durable(_confirmed(met, sets))
    # another centre in each bucket
    open_ = _open(rows, durable(_hops(links)))
    new = durable(_star(open_, F.xxhash64("node", "bucket")).join(met, ["u", "v"], "left_anti"))
    links = links.unionByName(durable(_confirmed(new, sets)))
    roots = durable(connected(links))
    left = durable(_open(open_.drop("label"), roots).select("node", "label").distinct())
    if left.isEmpty():
        return roots
    pairs = _joined(durable(_prefixes(sets.join(left, "node"))))
    rest = durable(_confirmed(durable(pairs.join(met.unionByName(new), ["u", "v"], "left_anti")), sets))
    if rest.isEmpty():
        return roots
    # components of components
    ends = [left.select(F.col("node").alias(c), F.col("label").alias(f"{c}_")) for c in "uv"]
    over = durable(connected(rest.join(ends[0], "u").join(ends[1], "v").select(F.col("u_").alias("u"), F.col("v_").alias("v"))))
    every = roots.unionByName(over.select("node", F.col("node").alias("root"))).unionByName(over.select(F.col("root").alias("node"), "root")).distinct()
    top = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return every.join(top, "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    rows = durable(marked(docs))
    some = rows.where("n > 0")
    nodes = durable(some.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("k").alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    roots = classes(docs, nodes)
    named = durable(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    components = durable(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = named.join(components, "root").select("node", "component_id")
    out = some.select("node", "doc_id", "n").join(by_node, "node").select("doc_id", "n", "component_id").unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT doc_id, n, s FROM s JOIN n USING (doc_id)),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON r.node = e.u),
m AS (SELECT node AS doc_id, min(c) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
