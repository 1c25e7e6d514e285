"""Quality of documents: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (lengths, character classes, repeated words and lines) are standardised and mapped to cosine
features that approximate a Gaussian kernel; beside the cosines the ridge has the standardised statistics themselves, clipped, as linear
terms, and a constant. Each partition sums its part of the normal equations; the sum of the
parts gives the ridge weights. Scores of labelled rows that the ridge has not seen are binned, and isotonic regression
over the bins turns scores into probabilities.

Only labelled rows whose crc32(doc_id as text) mod 5 is 2, 3 or 4 fit the ridge, those of remainder 1 fit the
calibration, and those of remainder 0 are held out. Both fits take at most about FIT_ROWS rows, chosen by hash.

Defined cases: a null text is empty, and empty texts get the statistics of no words; a null doc_id is scored and not
held out; labels that contradict each other for a doc_id are averaged; a null label is none; without usable labels
of both kinds every score is 0.5; repeated rows are scored each; very long texts are read whole; an empty table gives an empty result. Labels,
lang, source and doc_id are no inputs of a score, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import durable

FIT_ROWS = 40_000
N_FOURIER, RIDGE, SEED = 256, 1e-4, 5
PARTS, BINS = 8, 512
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.intp)
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\t\n\v\f\r ", b".,;:'\"?()-", b"!", b"|", b"*$%&#@~^_=+<>/\\{}[]`"), start=1):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 9
N_STATS = 18


def statistics(text: str | None) -> list[float]:
    """What a whole text looks like, in numbers that don't depend on its language."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_STATS
    n, size = len(words), len(raw)
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10)
    letters = by_class[1] + by_class[2] + by_class[9]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    twice = sum(map(eq, words, words[1:]))
    return [
        np.log1p(n),
        min(size / n, 40.0),
        by_class[2] / max(1.0, letters),
        by_class[3] / size,
        by_class[5] / size,
        min(by_class[6] / n, 2.0),
        min(by_class[7] / n, 2.0),
        min(by_class[8] / n, 4.0),
        by_class[0] / size,
        by_class[9] / size,
        twice / n,
        len(counts) / n,
        np.log1p(len(counts)) / np.log1p(n),
        max(counts.values()) / n,
        min(len(lines) / n, 1.0),
        1.0 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
        np.log1p(len(lines)),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, fold, stats) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    return rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), fold.alias("fold"), "stats")


class Model:
    """Standardisation, cosine features, ridge weights and the calibration's corners."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, 1.0 / np.sqrt(N_STATS / 2), (N_STATS, N_FOURIER))
        self.b = rng.uniform(0.0, 2 * np.pi, N_FOURIER)
        self.beta = np.zeros(N_FOURIER + N_STATS + 1)
        self.corners = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6.0, 6.0)
        return np.hstack((np.cos(z @ self.w + self.b) * np.sqrt(2.0 / N_FOURIER), z / 6.0, np.ones((len(z), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.beta, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.corners)


def isotonic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of pooled neighbours: values never fall. x ascends."""
    blocks: list[list[float]] = []
    for a, k, m in zip(x, ones, n, strict=True):
        blocks.append([a * m, k, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stats_of(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """A model from the labelled rows of folds 1 to 4; stats as ``measured`` gives them."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.avg(label).alias("y"))
    used = marks.where(F.pmod(F.crc32(F.col("of").cast("string")), F.lit(5)) != 0)
    step = max(1, -(-used.count() // FIT_ROWS))
    used = used.where(F.pmod(F.xxhash64("of"), F.lit(step)) == 0)
    rows = durable(stats.join(used, F.col("doc_id") == F.col("of")).select("doc_id", "fold", "y", "stats"))
    ridge = rows.where("fold > 1")
    moments = ridge.agg(F.count("*"), F.min("y"), F.max("y"), *[f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0] or moments[1] == moments[2]:
        return None
    model = Model(np.array(moments[3::2]), np.maximum(np.array(moments[4::2]), 1e-6))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.beta)
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                x = model.features(_stats_of(b, 1))
                total[:, :size] += x.T @ x
                total[:, size] += x.T @ b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = ridge.coalesce(PARTS).sortWithinPartitions("doc_id", "y", "stats").select("y", "stats").mapInArrow(partial, "part binary").collect()
    size = len(model.beta)
    total = np.sum([np.frombuffer(p[0]).reshape(size, size + 1) for p in sorted(parts)], axis=0)
    model.beta = np.linalg.solve(total[:, :size] + RIDGE * moments[0] * np.eye(size), total[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.round(model.raw(_stats_of(b, 1)) * BINS) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(int), pa.int32()), b.column(0)], names=["at", "y"])

    bins = sorted(tuple(r) for r in rows.where("fold = 1").select("y", "stats").mapInArrow(binned, "at int, y double").groupBy("at").agg(F.sum("y"), F.count("*")).collect())
    if bins:
        model.corners = isotonic(*(np.array(c, float) for c in zip(*((a / BINS, k, n) for a, k, n in bins), strict=True)))
    else:
        model.corners = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    stats = durable(measured(docs))
    model = fit(stats, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, 0.5) if model is None or not b.num_rows else model.score(_stats_of(b, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "held_out", "stats").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
