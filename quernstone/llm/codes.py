"""Vector codes: product quantisation with a kd-tree for each part's codebook.

Components become floor(256 * x), and vectors are cut into PARTS equal parts. A part's codebook starts as that part of the ENTRIES smallest
vec_ids. Each round every task gets the rounds' codebooks as kd-trees (PARTS * ENTRIES parts of a vector, whatever the number of rows), finds
the nearest entry of each part of its rows by branch and bound, and gives integer sums by entry, from which the driver takes the new entries.
A branch is left out only if its box is farther away than the best entry so far: boxes at an equal distance are visited, so that the
lower index is found where distances tie.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors, and dimensions that PARTS doesn't
divide, count as padded with zeros; a vec_id that several rows have gives one entry, of the least of its vectors, and each row its own code; a
row without vec_id is coded and counted, but starts no entry; fewer rows than ENTRIES give fewer entries; components beyond the range of long
are held at its ends, as are errors; null labels are one label, and so are all rows of a table without labels; wide vectors go in smaller
batches; an empty table gives an empty result. Columns other than vec_id, embedding and label are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import durable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Entries in a leaf of a tree.
LEAF = 8
#: Bytes of components that are searched at a time.
CHUNK_BYTES = 4 << 20
LOW, HIGH = -(2**63), 2**63 - 1
#: Squared distances are summed in longs if they can't reach this.
SAFE = 2**62


@dataclass
class Node:
    """A branch (left, right) or a leaf (ids, ascending) of a tree, and the box around its entries."""

    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    ids: np.ndarray | None = None


def tree(entries: np.ndarray, ids: np.ndarray | None = None) -> Node:
    """A kd-tree over the rows of ``entries``, cut at the median of the widest axis."""
    ids = np.arange(len(entries)) if ids is None else ids
    own = entries[ids]
    node = Node(own.min(0), own.max(0))
    # Python numbers: the width of a box may be more than a long
    wide = [int(h) - int(x) for h, x in zip(node.high, node.low, strict=True)]
    node.axis = wide.index(max(wide))
    if len(ids) > LEAF and max(wide) > 0:
        values = own[:, node.axis]
        node.cut = np.sort(values)[len(ids) // 2]
        below = values < node.cut
        if not below.any():  # the median is the least value
            node.cut = values[values > node.cut].min()
            below = values < node.cut
        node.left, node.right = tree(entries, ids[below]), tree(entries, ids[~below])
    else:
        node.ids = np.sort(ids)
    return node


def nearest(root: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the index of the nearest entry, ties to the lower index, and its squared distance. Both arrays hold longs, or Python's whole numbers."""
    best = np.full(len(points), np.iinfo(np.int64).max, points.dtype) if points.dtype != object else np.full(len(points), 2**200, object)
    found = np.full(len(points), len(entries))

    def reach(node: Node, at: np.ndarray) -> np.ndarray:
        """Those points whose best distance isn't below that of the node's box."""
        x = points[at]
        off = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        return at[(off * off).sum(1) <= best[at]]

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.ids is not None:
            off = points[at][:, None, :] - entries[node.ids][None]
            d = (off * off).sum(2)
            k = d.argmin(1)  # the first of equals: ids ascend
            d, k = d[np.arange(len(at)), k], node.ids[k]
            better = (d < best[at]) | ((d == best[at]) & (k < found[at]))
            best[at[better]], found[at[better]] = d[better], k[better]
            return
        first = points[at, node.axis] < node.cut
        near, far = at[first], at[~first]
        visit(node.left, near)
        visit(node.right, far)
        visit(node.right, reach(node.right, near))
        visit(node.left, reach(node.left, far))

    visit(root, np.arange(len(points)))
    return found, best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v: whole numbers, held within long."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    # a double beyond the range of long is cast to its end
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(F.lit(2.0**63), x.cast("double") * SCALE))).cast("long"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"))


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column of longs, padded with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's whole numbers where sums of squared distances might leave long."""
    most = max(int(a.max(initial=0)) - int(a.min(initial=0)) for a in (x, book)) + max(abs(int(x.max(initial=0)) - int(book.min(initial=0))), abs(int(book.max(initial=0)) - int(x.min(initial=0))))
    return (x, book) if most * most * x.shape[1] < SAFE else (x.astype(object), book.astype(object))


def assigned(x: np.ndarray, books: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances summed over parts of the rows of x; books: (parts, entries, width)."""
    parts, _, width = books.shape
    x, books_ = _exact(x, books)
    if books_.dtype == object:
        trees = [tree(b) for b in books_]
    codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), x.dtype)
    for p in range(parts):
        codes[:, p], d = nearest(trees[p], books_[p], x[:, p * width : (p + 1) * width])
        error = error + d
    return codes, error


def _chunks(b: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, CHUNK_BYTES // (8 * dim))
    for a in range(0, b.num_rows, step):
        yield a, _matrix(b.slice(a, step).column(b.num_columns - 1), dim)


def _sums(rows: DataFrame, books: np.ndarray, trees: list[Node]) -> DataFrame:
    """(part, entry, place, total) of each task: what its rows add to each component of an entry; place -1: their number."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), object)
        some = False
        for b in batches:
            for _, x in _chunks(b, parts * width):
                some = True
                codes, _ = assigned(x, books, trees)
                exact = int(np.abs(x.astype(float)).max(initial=0)) * len(x) >= SAFE
                for p in range(parts):
                    own = np.zeros((entries, width + 1), object if exact else np.int64)
                    np.add.at(own, codes[:, p], np.column_stack([x[:, p * width : (p + 1) * width], np.ones(len(x), np.int64)]).astype(own.dtype))
                    total[p] += own
        if some:
            p, e, w = np.nonzero(total != 0)
            values = pa.array([str(v) for v in total[p, e, w]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(np.where(w == width, -1, w), pa.int32()), values], names=["part", "entry", "place", "total"])

    each = rows.select("v").mapInArrow(run, "part int, entry int, place int, total string")
    return each.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of usable rows; None without rows that could start one. The driver sees codebooks only."""
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return None
    width = max(1, -(-dim // parts))
    ids = [r[0] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    first = {r["vec_id"]: r["v"] for r in rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()} if ids else {}
    if not first:
        return None
    start = np.array([first[i] + [0] * (parts * width - len(first[i])) for i in ids], np.int64)
    books = np.ascontiguousarray(start.reshape(len(ids), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        new = books.copy()
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for r in _sums(rows, books, [tree(b) for b in books]).collect():
            totals.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["total"])
        for (p, e), t in totals.items():
            new[p, e] = [t.get(w, 0) // t[-1] for w in range(width)]
        books = new
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each usable row of ``vectors`` (vec_id, embedding, label)."""
    rows = durable(usable(vectors))
    books = trained(rows, parts, entries, rounds)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    trees = [tree(b) for b in books]
    _, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in _chunks(b, parts * width):
                found, error = assigned(x, books, trees)
                text = [bytes(c).hex() for c in found.astype(np.uint8)] if entries <= 256 else ["".join(f"{k:04x}" for k in c) for c in found]
                far = pa.array([min(HIGH, int(e)) for e in error], pa.int64())
                ids, labels = (b.column(k).slice(a, len(x)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), far], names=["vec_id", "label", "code", "error"])

    coded = durable(rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long"))
    total = F.least(F.lit(HIGH).cast("decimal(38,0)"), F.sum(F.col("error").cast("decimal(19,0)"))).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "own")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign_sql(k: int) -> str:
    """Round k: parts get their nearest entry of codebook b{k}."""
    return f"""a{k} AS (SELECT vec_id, part, min(dist * 64 + entry) AS best FROM (
  SELECT p.vec_id, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist
  FROM p JOIN b{k} b ON p.part = b.part) GROUP BY vec_id, part)"""


def _update_sql(k: int) -> str:
    """Codebook b{k + 1}: floors of means, and entries without parts as they were."""
    return f"""m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM (
  SELECT part, CAST(best % 64 AS BIGINT) AS entry, place, CAST(sum(x[place]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.part, a.best, p.x, unnest(range(1, len(p.x) + 1)) AS place FROM a{k} a JOIN p USING (vec_id, part)) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""


ORACLE = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, CAST(part AS BIGINT) AS part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM (SELECT vec_id, v, unnest(range(16)) AS part FROM e)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < 64),
b0 AS (SELECT part, entry, x FROM p JOIN s USING (vec_id)),
{_assign_sql(0)}, {_update_sql(0)}, {_assign_sql(1)}, {_update_sql(1)}, {_assign_sql(2)},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(best % 64 AS INT)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN e USING (vec_id), h
"""
