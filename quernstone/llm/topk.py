"""Exact top-k by integer inner product: a Voronoi join of queries with all rows.

Components become floor(256 * x). A few pivots, taken from the data, divide queries and data into cells. From summaries of
the data cells (size, radius, the distances nearest to the pivot) follows for each query a score that at least k
rows reach, and for each query cell the least of these. A row x can be among the best of a query cell with centre c and
radius r only if <c, x> + r |x| reaches that: it is copied to those cells alone. There, blocks of queries meet
chunks of rows in matrix products, and the best k of each query and task are merged.

How much a cell is spared depends on the data: vectors that lie in tight groups go to few cells, vectors spread evenly over many
dimensions to all of them, as every cell's bound then covers every row. ``copies`` tells how many cells a row goes to.

Defined cases: vectors that are null or have a null or non-finite component take no part, nor do rows without vec_id;
shorter vectors count as padded with zeros, also where all are empty; a repeated row is a candidate each time, and asks once; different vectors under one vec_id ask each, and their results are one list of the best, in which a row may stand twice; a row that
shares the query's vec_id is its own; scores beyond the range of long are held at its ends; ties go to the smaller vec_id; fewer candidates
than k give fewer rows; wide vectors go in smaller chunks; an empty table gives an empty result. Columns other than vec_id and embedding
are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import durable

K, PIVOTS, SCALE = 5, 32, 256.0
#: Queries in a block of the local solution, and bytes of a chunk of rows, both at most.
BLOCK, CHUNK_BYTES = 1024, 1 << 20
LOW, HIGH = -(2**63), 2**63 - 1
#: Sums of products up to here are exact in doubles.
EXACT = 2.0**52


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column of doubles (whole numbers), padded with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows of a with all of b."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= EXACT:
        big = [[int(x) for x in row] for row in b]
        return np.array([[max(LOW, min(HIGH, sum(x * y for x, y in zip(p, q, strict=True)))) for q in big] for p in ([int(x) for x in row] for row in a)], np.int64).reshape(len(a), len(b))
    return (a @ b.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k best scores, ties to the smaller id. A score of LOW with id HIGH stands for none."""
    if scores.shape[1] > 4 * k:
        # all that reach the k-th best score stay, ties included
        cut = scores.shape[1] - k
        floor = np.partition(scores, cut, axis=1)[:, cut : cut + 1]
        keep = scores >= floor
        width = int(keep.sum(1).max())
        if width < scores.shape[1]:
            s, i = np.full((len(scores), width), LOW), np.full((len(scores), width), HIGH)
            r, c = np.nonzero(keep)
            at = np.arange(len(r)) - np.repeat(np.cumsum(keep.sum(1)) - keep.sum(1), keep.sum(1))
            s[r, at], i[r, at] = scores[r, c], ids[r, c] if ids.ndim == 2 else ids[c]
            scores, ids = s, i
    if ids.ndim == 1:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v: whole numbers as doubles."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # doubles beyond 1e15 are whole numbers
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * SCALE) < 1e15, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def topk(vectors: DataFrame, every: int = 50, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows for each row whose vec_id is a multiple of ``every``."""
    rows = durable(usable(vectors))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    _, found = _joined(rows, max(1, dim), every, k, pivots)
    found = _by_few(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_few(df: DataFrame, rows: int = 32) -> DataFrame:
    """``df``, computed with few rows in a batch for Python: each holds a block of queries and a chunk of rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, str(rows))
    try:
        return durable(df)
    finally:
        conf.set(name, usual)


def copies(vectors: DataFrame, every: int = 50, k: int = K, pivots: int = PIVOTS) -> float:
    """How many query cells a row goes to on average."""
    rows = durable(usable(vectors))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return 0.0
    chunks, _ = _joined(rows, max(1, dim), every, k, pivots)
    return (chunks.agg(F.sum(F.length("ids"))).first()[0] or 0) / 8 / rows.count()


def _joined(rows: DataFrame, dim: int, every: int, k: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """The chunks of rows (cell, ids, xs) that go to query cells, and each task's best (query_id, vec_id, score)."""
    chunk_rows = max(16, CHUNK_BYTES // (8 * dim))
    step = max(1, rows.count() // (pivots * 8))
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("v", "vec_id").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(pivots).collect()
    p = np.zeros((max(1, len(some)), dim))
    for i, r in enumerate(some):
        p[i, : len(r["v"])] = r["v"]
    pp = (p * p).sum(1)

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * (x @ p.T) + pp))
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at]

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        for b in batches:
            at, d = cells(_matrix(b.column(0), dim))
            for c in np.unique(at):
                near[c] = np.sort(np.concatenate((near.get(c, np.empty(0)), d[at == c])))[: k + 1]
        if near:
            yield pa.RecordBatch.from_arrays([pa.array([int(c) for c in near], pa.int32()), pa.array([v.tolist() for v in near.values()], pa.list_(pa.float64()))], names=["cell", "near"])

    # the k + 1 distances nearest to each pivot; one of the rows may be the query's own
    nearest = rows.select("v").mapInArrow(summarised, "cell int, near array<double>").select("cell", F.explode("near").alias("d"))
    w = Window.partitionBy("cell").orderBy("d")
    near = {r["cell"]: sorted(r["near"]) for r in nearest.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("cell").agg(F.collect_list("d").alias("near")).collect()}
    owner = np.repeat(np.array(sorted(near), int), [len(near[c]) for c in sorted(near)])
    reach = np.concatenate([near[c] for c in sorted(near)])

    def floors(x: np.ndarray) -> np.ndarray:
        """A score that k rows besides the query itself reach; -inf if there may be fewer."""
        if len(owner) <= k:
            return np.full(len(x), -np.inf)
        low = x @ p[owner].T - np.sqrt((x * x).sum(1))[:, None] * reach
        return np.partition(low, len(owner) - k - 1, axis=1)[:, len(owner) - k - 1]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            at, d = cells(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(d), pa.array(floors(x))], names=["vec_id", "v", "cell", "d", "floor"])

    queries = durable(rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(asked, "vec_id long, v array<double>, cell int, d double, floor double"))
    groups = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.min("floor").alias("floor")).collect()
    blocks = {r["cell"]: -(-r["n"] // BLOCK) for r in groups}
    g = np.array([r["cell"] for r in groups], int)
    radius, least = np.array([r["r"] for r in groups]), np.array([r["floor"] for r in groups])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the rows that a query cell needs, with their ids."""
        held: dict[int, list] = {}

        def chunk(c: int) -> pa.RecordBatch:
            ids, xs = (np.concatenate(z) for z in zip(*held.pop(c), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([xs.tobytes()], pa.binary())], names=["cell", "ids", "xs"])

        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            if not len(ids) or not len(g):
                continue
            # a hair above rounding errors
            can = x @ p[g].T + radius * np.sqrt((x * x).sum(1))[:, None]
            keep = can + 1e-6 * (1.0 + np.abs(can)) >= least
            for j in np.nonzero(keep.any(0))[0]:
                c, own = int(g[j]), keep[:, j]
                for a in range(0, int(own.sum()), chunk_rows):
                    held.setdefault(c, []).append((ids[own][a : a + chunk_rows], x[own][a : a + chunk_rows]))
                    if sum(len(z[0]) for z in held[c]) >= chunk_rows:
                        yield chunk(c)
        for c in list(held):
            yield chunk(c)

    chunks = rows.mapInArrow(needed, "cell int, ids binary, xs binary")
    n_blocks = F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]) if blocks else F.lit(None).cast("map<int,int>")
    salted = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks[F.col("cell")] - 1)))
    # a query's block by its hash: about BLOCK queries each
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks[F.col("cell")].cast("long")).cast("int")).groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("q"))
    met = salted.join(packed.select("cell", "block", "q"), ["cell", "block"]).select("q", "ids", "xs")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}
        size = 0

        def out(q: np.ndarray, s: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
            r, c = np.nonzero(i != HIGH)
            return pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(i[r, c]), pa.array(s[r, c])], names=["query_id", "vec_id", "score"])

        for b in batches:
            for n in range(b.num_rows):
                own = b.column(0).slice(n, 1).flatten()
                qi = own.field("vec_id").to_numpy()
                ids = np.frombuffer(b.column(1)[n].as_py(), np.int64)
                xs = np.frombuffer(b.column(2)[n].as_py()).reshape(-1, dim)
                s = _products(_matrix(own.field("v"), dim), xs)
                same = qi[:, None] == ids[None, :]
                s[same] = LOW
                s, i = _best(s, np.where(same, HIGH, ids[None, :]), k)
                key = qi.tobytes()
                if key in best:
                    s, i = _best(np.hstack((best[key][1], s)), np.hstack((best[key][2], i)), k)
                else:
                    size += len(qi)
                best[key] = qi, s, i
                if size > 64 * BLOCK:
                    for x in best.values():
                        yield out(*x)
                    best, size = {}, 0
        for x in best.values():
            yield out(*x)

    return chunks, met.mapInArrow(solved, "query_id long, vec_id long, score long")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
