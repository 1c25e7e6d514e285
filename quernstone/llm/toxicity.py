"""Toxicity: a chain of linear classifiers, one category after the other.

Categories come in a given order. Each has a logistic model over word counts and text statistics; from the second on, the models
also see the probabilities of the categories before. What they are trained with is out of fold: labelled rows are dealt into
FOLDS by hash, and a row's earlier probabilities come from models that did not see its fold. At scoring, models trained on all
folds follow each other.

The categories here are those that ``labels`` marks: low quality (quality = 0), then toxic, so that the model for toxic
text knows what kind of junk a text is. Any other list of 0/1 columns may be given.

Words of the models, and beginnings of words (4 to 6 letters and a star), are the FIT_WORDS most telling of the labelled
rows by chi-square, each in MIN_ROWS different texts or more; the fit takes at most about FIT_ROWS labelled rows, chosen by hash, equal texts once.

Defined cases: a null text is empty; an empty text has no words, and its probability is the model's constant; a null
label is no label for its category; contradicting labels of a doc_id are averaged and cut at a half; rows are scored
each, repeated or without doc_id; a category without both labels has probability 0; an empty table gives an empty result.
Columns other than doc_id and text, and the labels' columns, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import durable
from quernstone.llm.quality import N_STATS, statistics

FIT_ROWS, FIT_WORDS, MIN_ROWS, FOLDS = 10_000, 256, 5, 5
L2, ROUNDS, THRESHOLD = 1.0, 25, 0.5
WORDS = re.compile(r"[^\W\d_]+")


STARTS = (4, 5, 6)


def tokens(w: str) -> list[str]:
    return [w, *(f"{w[:n]}*" for n in STARTS if len(w) > n)]


def counted(text: str | None, index: dict[str, int]) -> np.ndarray:
    """log(1 + count) of the words and beginnings in ``index``."""
    x = np.zeros(len(index))
    if text:
        get = index.get
        for w, n in Counter(WORDS.findall(text.lower())).items():
            for t in tokens(w):
                k = get(t)
                if k is not None:
                    x[k] += n
    return np.log1p(x)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the constant last, by Newton steps with an L2 penalty."""
    x = np.hstack((x, np.ones((len(x), 1))))
    penalty = np.full(x.shape[1], L2)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    if w is None:
        return np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def chain_fit(x: np.ndarray, ys: Sequence[np.ndarray], fold: np.ndarray) -> list[np.ndarray | None]:
    """Weights of each category; ys: 0, 1 or nan. Earlier probabilities are appended to x, out of fold."""
    models: list[np.ndarray | None] = []
    for y in ys:
        known = ~np.isnan(y)

        def fitted(rows: np.ndarray, x: np.ndarray = x, y: np.ndarray = y) -> np.ndarray | None:
            return logistic(x[rows], y[rows]) if rows.any() and len(set(y[rows])) > 1 else None

        models.append(fitted(known))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            held = fold == f
            out[held] = probability(x[held], fitted(known & ~held))
        x = np.hstack((x, out[:, None]))
    return models


def _longer(n: int):
    return lambda w: F.length(w) > n


def _start(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> tuple[dict[str, int], np.ndarray, np.ndarray, list]:
    """Words, standardisation and models. categories: name to an SQL expression over ``labels`` that is 0, 1 or null."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*[F.avg(F.expr(e)).alias(f"y_{n}") for n, e in enumerate(categories.values())])
    step = max(1, -(-marks.count() // FIT_ROWS))
    marks = marks.where(F.pmod(F.xxhash64("of"), F.lit(step)) == 0)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(marks, F.col("doc_id") == F.col("of"))
    ys = [f"y_{n}" for n in range(len(categories))]
    # equal texts once: the row of the least doc_id
    rows = durable(rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min_by(F.struct("text", *ys), "doc_id").alias("r")).select("h", "r.*"))
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    starts = [F.transform(F.filter("own", _longer(n)), _start(n)) for n in STARTS]
    words = rows.select(*ys, own.alias("own")).select(*ys, F.explode(F.array_distinct(F.concat("own", *starts))).alias("w"))
    totals = rows.agg(F.count("*"), *[F.sum(F.when(F.col(y) > 0.5, 1).otherwise(0)) for y in ys]).first()
    n = totals[0]
    by_word = words.groupBy("w").agg(F.count("*").alias("df"), *[F.sum(F.when(F.col(y) > 0.5, 1).otherwise(0)).alias(y) for y in ys]).where(F.col("df") >= MIN_ROWS)
    best: list[str] = []
    for k, y in enumerate(ys):
        ones = totals[k + 1] or 0
        gap = F.col(y) * F.lit(n) - F.col("df") * F.lit(ones)
        chi = gap * gap / (F.col("df") * (F.lit(n) - F.col("df") + 1))
        # only words that speak for the category
        best += [r["w"] for r in by_word.where(gap > 0).orderBy(chi.desc(), "w").limit(FIT_WORDS // len(ys)).select("w").collect()]
    index = {w: k for k, w in enumerate(dict.fromkeys(best))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.concatenate((statistics(t.as_py()), counted(t.as_py(), index))).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), *b.columns[2:]], names=["h", "x", *ys])

    got = sorted(rows.select("h", "text", *ys).mapInArrow(run, "h long, x array<double>, " + ", ".join(f"{y} double" for y in ys)).collect())
    if not got:
        return index, np.zeros(N_STATS), np.ones(N_STATS), [None] * len(ys)
    x = np.array([r[1] for r in got])
    mean, scale = x[:, :N_STATS].mean(0), np.maximum(x[:, :N_STATS].std(0), 1e-6)
    x[:, :N_STATS] = np.clip((x[:, :N_STATS] - mean) / scale, -5, 5)
    marks_ = [np.array([np.nan if r[2 + k] is None else float(r[2 + k] > 0.5) for r in got]) for k in range(len(ys))]
    return index, mean, scale, chain_fit(x, marks_, np.array([r[0] for r in got]) % FOLDS)


CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each category, and predicted (1 if the last one's is threshold or more) of each row."""
    index, mean, scale, models = fit(docs, labels, categories)
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([np.concatenate((statistics(t), counted(t, index))) for t in b.column(1).to_pylist()]).reshape(b.num_rows, N_STATS + len(index))
            x[:, :N_STATS] = np.clip((x[:, :N_STATS] - mean) / scale, -5, 5)
            for w in models:
                x = np.hstack((x, probability(x, w)[:, None]))
            ps = [x[:, N_STATS + len(index) + k] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, ps), pa.array((ps[-1] >= threshold).astype(np.int32))], names=["doc_id", *names, "predicted"])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", predicted int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
