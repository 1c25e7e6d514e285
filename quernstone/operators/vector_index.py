"""A stored index of vectors for approximate search by cosine: an inverted file of cells with residual codes.

Unit vectors are dealt to the nearest of about sqrt(n) centres, and what a centre leaves is coded in a byte for every WIDTH components. Centres, code books and the number
of cells that a search opens are fitted on a bounded sample; every row is indexed. Tables are kept apart by dimension, and rows lie in order of their cells.

A search opens a query's nearest cells, reads codes of the rows there that pass its filter, keeps the best ``depth`` by what the codes say, and ranks these by
their own vectors. A query that finds fewer rows than it asks for, as its filter leaves few, opens twice as many cells, until it has them or all are open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.ranking import ranked
from quernstone.operators.vector import ASKED, _unit, cosine, cosine_topk
from quernstone.sources import manifest
from quernstone.sources.sinks import kept

#: Rows and bytes of a dimension's sample, at most; its rows are the first by hash of the key.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Centres of a dimension at most; components of a code; values of a code.
CELLS, WIDTH, VALUES = 1024, 4, 256
#: Recall at AMONG that a search of the sample must have with the cells it opens.
RECALL, AMONG, TRIALS = 0.97, 20, 200
#: Queries that go to every task at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Model:
    """What is fitted for a dimension: centres (cells, dim), books (parts, values, WIDTH) and how many cells a search opens."""

    dim: int
    centres: np.ndarray
    books: np.ndarray
    probes: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)

    def coded(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts = _parts(x - self.centres[cells])
        out = np.empty((len(x), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = (parts[:, p] @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
        return out

    def decoded(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)[:, : self.dim]
        return self.centres[cells] + rest

    def opened(self, q: np.ndarray, probes: int) -> np.ndarray:
        """Of each query the cells that it opens, nearest first."""
        score = q @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        return np.argsort(-score, axis=1, kind="stable")[:, :probes]


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows in parts of WIDTH components, zeros behind the last."""
    n = -(-x.shape[1] // WIDTH)
    return np.pad(x, ((0, 0), (0, n * WIDTH - x.shape[1]))).reshape(len(x), n, WIDTH)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x, by rounds of means; a centre without rows stays."""
    out = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ out.T - 0.5 * (out**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def fitted(sample: np.ndarray, n: int, recall: float = RECALL, seed: int = 11) -> Model:
    """The model of a dimension from a sample (rows) of its n vectors."""
    rng, x = np.random.default_rng(seed), _unit(sample)
    centres = _means(x, max(1, min(CELLS, int(n**0.5), len(x))), 10, rng)
    near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
    parts = _parts(x - centres[near])
    books = np.stack([_means(parts[:, p], min(VALUES, len(x)), 6, rng) for p in range(parts.shape[1])])
    model = Model(x.shape[1], centres, books, len(centres))
    asked = x[rng.permutation(len(x))[:TRIALS]]
    best = np.argsort(-(asked @ x.T), axis=1)[:, :AMONG]
    order = np.argsort(model.opened(asked, len(centres)), axis=1)  # of each query and cell: when it is opened
    when = order[np.arange(len(asked))[:, None], near[best]]
    probes = next(m for m in range(1, len(centres) + 1) if (when < m).mean() >= min(recall, 1.0))
    return Model(model.dim, centres, books, probes)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    root: str
    key: str = "vec_id"

    def models(self) -> dict[int, Model]:
        entries = manifest.latest(self.spark, self.root).entries
        if not entries:
            return {}
        made = {}
        for r in self.spark.read.parquet(f"{self.root}/models/{entries['id']}").collect():
            shape = json.loads(r["shape"])
            made[r["dim"]] = Model(r["dim"], np.frombuffer(r["centres"]).reshape(-1, r["dim"]), np.frombuffer(r["books"]).reshape(shape), r["probes"])
        return made

    def rows(self) -> DataFrame:
        """(key, cell, code, embedding, dim, and what else the vectors have)."""
        return self.spark.read.parquet(f"{self.root}/rows/{manifest.latest(self.spark, self.root).entries['id']}")


def build(index: VectorIndex, vectors: DataFrame, recall: float = RECALL) -> VectorIndex:
    """Indexes ``vectors`` (key, embedding, and columns for filters); null vectors are left out. Becomes current in one step."""
    spark, name = index.spark, uuid.uuid4().hex
    v = kept(vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("dim", F.size("embedding")))
    models: dict[int, Model] = {}
    # a row for each dimension
    for r in v.groupBy("dim").agg(F.count("*").alias("n")).collect():
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * r["dim"])))
        sample = v.where(F.col("dim") == r["dim"]).select(index.key, "embedding").orderBy(F.xxhash64(index.key), index.key).limit(most).collect()
        models[r["dim"]] = fitted(np.array([s["embedding"] for s in sample]), r["n"], recall)
    made = [(m.dim, m.centres.tobytes(), m.books.tobytes(), json.dumps(m.books.shape), m.probes) for m in models.values()]
    spark.createDataFrame([(d, bytearray(c), bytearray(b), s, p) for d, c, b, s, p in made], "dim int, centres binary, books binary, shape string, probes int").coalesce(1).write.parquet(f"{index.root}/models/{name}")
    at = v.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(at).offsets.to_numpy())
            cells, codes = np.zeros(len(sizes), np.int32), [b""] * len(sizes)
            for d in np.unique(sizes):
                own = np.nonzero(sizes == d)[0]
                x = _unit(b.column(at).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                cells[own] = models[d].cells(x)
                for i, c in zip(own, models[d].coded(x, cells[own]), strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(codes, pa.binary())], names=[*b.schema.names, "cell", "code"])

    schema = T.StructType([*v.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])
    coded = v.mapInArrow(run, schema)
    coded.repartitionByRange("dim", "cell", index.key).sortWithinPartitions("dim", "cell", index.key).write.partitionBy("dim").parquet(f"{index.root}/rows/{name}")
    manifest.update(spark, index.root, lambda _: {"id": name})
    return index


def search(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, depth: int | None = None) -> DataFrame:
    """query_id, key, score, rank: for each of ``queries`` (query_id, q) about the best k rows that ``where`` holds for, with their exact scores.

    probes: cells to open instead of the fitted number; depth: candidates that are ranked by their own vectors, 10 k by default. With all cells and as many
    candidates as rows the result is exact. A stated query set goes to the tasks in blocks of BLOCK; rows of another dimension than a query's don't meet it.
    """
    models, rows = index.models(), index.rows()
    rows = rows if where is None else rows.where(where)
    depth = max(k, depth or 10 * k)
    if depth != 10 * k and probes is not None and all(probes >= len(m.centres) for m in models.values()) and depth >= index.rows().count():
        # nothing is left to the codes: all rows are ranked by their own vectors, each batch leaving its k best
        return cosine_topk(rows, queries, k, index.key)
    asked = kept(queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q")).withColumn("_block", F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / BLOCK)) if queries.limit(BLOCK + 1).count() > BLOCK else queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"), F.lit(0).alias("_block")))
    out = None
    for block in [r[0] for r in asked.select("_block").distinct().orderBy("_block").collect()]:
        found = _found(index, models, rows, asked.where(F.col("_block") == block), k, probes, depth)
        out = found if out is None else out.unionByName(found)
    kinds = [queries.schema["query_id"], T.StructField("key", rows.schema[index.key].dataType)]
    if out is None:
        out = index.spark.createDataFrame([], T.StructType(kinds))
    near = out.join(rows.select(F.col(index.key).alias("key"), "embedding"), "key").join(asked.select("query_id", "q"), "query_id")
    scored = near.where(F.size("embedding") == F.size("q")).select("query_id", F.col("key").alias(index.key), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return ranked(scored, k, index.key)


def _found(index: VectorIndex, models: dict[int, Model], rows: DataFrame, asked: DataFrame, k: int, probes: int | None, depth: int) -> DataFrame:
    """(query_id, key): the best ``depth`` of each query by codes, over as many cells as it takes to find k."""
    own = [(r["query_id"], _unit(np.array([r["q"]]))[0]) for r in asked.collect()]
    plan: dict[int, tuple[list, np.ndarray]] = {}
    for d in sorted({len(q) for _, q in own} & models.keys()):
        plan[d] = [i for i, q in own if len(q) == d], np.array([q for _, q in own if len(q) == d])
    opened = {d: min(len(models[d].centres), probes or models[d].probes) for d in plan}
    schema = T.StructType([asked.schema["query_id"], T.StructField("key", rows.schema[index.key].dataType), T.StructField("near", T.DoubleType())])
    done, out = set(), None
    while any(len(ids) for ids, _ in plan.values()):
        found = kept(_scan(index, models, rows, plan, opened, depth, schema))
        best = ranked(found, depth, "key", score="near").select("query_id", "key")
        if all(opened[d] >= len(models[d].centres) for d in plan):
            full = {i for ids, _ in plan.values() for i in ids}
        else:
            full = {r["query_id"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).collect()}
            full |= {i for d, (ids, _) in plan.items() for i in ids if opened[d] >= len(models[d].centres)}
        done |= full
        ready = kept(best.join(index.spark.createDataFrame([(i,) for i in full], T.StructType([asked.schema["query_id"]])), "query_id", "left_semi")) if full else None
        out = ready if out is None else out if ready is None else out.unionByName(ready)
        plan = {d: ([i for i in ids if i not in full], q[[i not in full for i in ids]]) for d, (ids, q) in plan.items()}
        opened = {d: min(len(models[d].centres), 2 * n) for d, n in opened.items()}
    return out if out is not None else index.spark.createDataFrame([], T.StructType(schema.fields[:2]))


def _scan(index: VectorIndex, models: dict[int, Model], rows: DataFrame, plan: dict, opened: dict[int, int], depth: int, schema: T.StructType) -> DataFrame:
    """(query_id, key, near): of each batch of rows the best of each query that has opened their cells."""
    askers: dict[int, dict[int, np.ndarray]] = {}
    wanted = None
    for d, (ids, q) in plan.items():
        cells = models[d].opened(q, opened[d]) if len(ids) else np.empty((0, 0), int)
        askers[d] = {int(c): np.nonzero((cells == c).any(1))[0] for c in np.unique(cells)}
        one = (F.col("dim") == d) & F.col("cell").isin(list(askers[d])) if askers[d] else F.lit(False)
        wanted = one if wanted is None else wanted | one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cells = (b.column(i).to_numpy() for i in (1, 2))
            keys = b.column(0)
            for d, (ids, q) in plan.items():
                at = np.nonzero(dims == d)[0]
                if not len(at) or not len(ids):
                    continue
                codes = np.frombuffer(b"".join(b.column(3).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                x = models[d].decoded(codes, cells[at])
                here, column = np.unique(cells[at], return_inverse=True)
                opens = np.zeros((len(ids), len(here)), bool)
                for n, c in enumerate(here):
                    opens[askers[d].get(int(c), []), n] = True
                who = np.nonzero(opens.any(1))[0]
                names = pa.array([ids[i] for i in who])
                # what goes out at a time has a bound, whatever the number of queries and cells
                for first in range(0, len(who), ASKED):
                    block = who[first : first + ASKED]
                    s = np.where(opens[block][:, column], q[block] @ x.T, -np.inf)
                    top = np.argpartition(-s, depth - 1, axis=1)[:, :depth] if depth < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    best = np.take_along_axis(s, top, 1)
                    asking, place = np.nonzero(best > -np.inf)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(first + asking)), keys.take(pa.array(at[top[asking, place]])), pa.array(best[asking, place])], names=["query_id", "key", "near"])

    return rows.where(wanted).select(F.col(index.key).alias("key"), F.col("dim").cast("int").alias("dim"), "cell", "code").mapInArrow(run, schema)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact results (query_id, key) that were found."""
    hit = exact.join(found.select("query_id", key), ["query_id", key], "left_semi").count()
    return hit / max(1, exact.count())
