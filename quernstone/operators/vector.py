"""Vector search by cosine: each vector of a query table against all rows, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.compute import sort_indices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.blocks import BOUND
from quernstone.operators.lexical import ranked
from quernstone.sources.sinks import kept

#: Bytes of query vectors that go to every task, at most.
QUERY_BYTES = 32 << 20
#: Queries that a batch of rows meets at a time.
ASKED = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank: the best k of ``vectors`` (key, embedding) for each of ``queries`` (query_id, q).

    A query set goes to every task as a matrix, BOUND rows and QUERY_BYTES of it at a time, which is measured first; batches of rows meet ASKED of them in a matrix
    product, each leaving its k best. Rows of another dimension than a query's don't meet it.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("q").cast("long")), F.lit(0))).first()
    parts = max(-(-n // BOUND), -(-8 * size // QUERY_BYTES))
    if parts <= 1:
        return _block_topk(vectors, queries, k, key)
    dealt, out = kept(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(parts)))), None
    for p in range(parts):
        one = kept(_block_topk(vectors, dealt.where(F.col("_block") == p).drop("_block"), k, key))
        out = one if out is None else out.unionByName(one)
    return out


def _block_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    by_dim: dict[int, tuple[list, np.ndarray]] = {}
    for r in queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q")).collect():
        by_dim.setdefault(len(r["q"]), ([], []))[0].append(r["query_id"])
        by_dim[len(r["q"])][1].append(r["q"])
    asked = {d: (ids, _unit(np.array(q, float).reshape(len(ids), d))) for d, (ids, q) in by_dim.items()}
    kinds = [queries.schema["query_id"].dataType, vectors.schema[key].dataType]
    ids_kind = T.StructType([T.StructField("query_id", kinds[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", key, "score"]
        for b in batches:
            b = b.take(sort_indices(b.column(0)))  # ties go to the smaller key
            keys, col = b.column(0), b.column(1)
            sizes, at = np.diff(col.offsets.to_numpy()), col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            for d, (ids, q) in asked.items():
                own = np.nonzero(sizes == d)[0]
                if not len(own):
                    continue
                x = _unit(flat[at[own][:, None] + np.arange(d)]).T
                for first in range(0, len(ids), ASKED):
                    s = np.round(q[first : first + ASKED] @ x, 6)
                    floor = np.partition(s, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)]
                    which, place = [], []
                    for i in range(len(s)):
                        c = np.nonzero(s[i] >= floor[i])[0]
                        c = c[np.argsort(-s[i, c], kind="stable")][:k]
                        which.append(np.full(len(c), i))
                        place.append(c)
                    which, place = np.concatenate(which), np.concatenate(place)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[first + i] for i in which], b.schema.field(2).type), keys.take(pa.array(own[place])), pa.array(s[which, place])], names=names)

    rows = vectors.where("embedding is not null").select(F.col(key), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast(ids_kind["query_id"].dataType).alias("_q"))
    found = rows.mapInArrow(run, T.StructType([T.StructField("query_id", kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())]))
    return ranked(found, k, key)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows by their norms; rows of norm 0 stay 0."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def pending(units: DataFrame, vectors: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units without a vector, or whose text has changed since: (key, text_hash) against (key, vector_hash)."""
    return units.join(vectors.select(key, "vector_hash"), key, "left").where(~F.col("vector_hash").eqNullSafe(F.col("text_hash"))).drop("vector_hash")


def progress(units: DataFrame, vectors: DataFrame, key: str = "unit_id") -> DataFrame:
    """One row: total and done (vectors of the present text)."""
    joined = units.join(vectors.select(key, "vector_hash"), key, "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("vector_hash") == F.col("text_hash")).alias("done"))
