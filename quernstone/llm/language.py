"""Language of web pages by Bayesian fusion: text, declared language, address.

The text's evidence is a naive Bayes likelihood over hashed byte trigrams, trained on at most FIT_DOCUMENTS labelled documents
of each language, chosen by hash; long texts count as EFFECTIVE independent trigrams at most. The declared language (the
lang attribute of the html element) counts by how often pages of each language declare it. The prior of a page comes from
its host, smoothed with the host's registered domain, that with the address suffix, that with all pages. All of these
are sums, by group, of what the text alone says of each page, less the page's own share, so that it isn't
counted twice. The three log terms add up, and the posterior is their softmax.

A page's text is that of all of its articles and main parts, if it has any, else all of it but menus, scripts and the like.

Defined cases: null or empty html has no text evidence and declares nothing; a null or odd url has the empty host, which is
one host; ties go to the language first by code; repeated rows are pages each; a page of any length is read whole; without labelled
documents there are no languages, and lang is null; more than LANGUAGES of them are an error, and none is left out; an empty table gives an
empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import durable

FIT_DOCUMENTS, LANGUAGES, SLOTS = 1_000, 1_000, 1 << 15
EFFECTIVE, STRENGTH, PARTS = 100, 4.0, 8

HIDDEN = re.compile(r"<(script|style|nav|head|footer|aside)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
TAG = re.compile(r"<[^<>]*>")
ARTICLE = re.compile(r"<(/?)(?:article|main)\b[^<>]*>", re.I)
LANG = r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible(page: str | None) -> str:
    """The text of a page, of its articles if it has any."""
    if not page:
        return ""
    rest = HIDDEN.sub(" ", page)
    parts, depth, at = [], 0, 0
    for m in ARTICLE.finditer(rest):
        if not m[1]:
            if not depth:
                at = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                parts.append(rest[at : m.start()])
    if depth:
        parts.append(rest[at:])
    return entities.unescape(TAG.sub(" ", " ".join(parts) if parts else rest))


def slots(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text without digits and punctuation."""
    b = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.int64)
    t = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((t * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


def fit(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of code, and log probabilities (language, slot)."""
    known = documents.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], np.zeros((0, SLOTS))
    step = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(1, r["n"] // FIT_DOCUMENTS))])
    few = known.where(F.pmod(F.xxhash64("text"), F.coalesce(step[F.col("lang")], F.lit(1)).cast("long")) == 0)
    at = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), SLOTS))
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = slots(text)
                if len(s):
                    total[at[lang]] += np.bincount(s, minlength=SLOTS) / len(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = few.select("lang", "text").coalesce(PARTS).mapInArrow(run, "part binary").collect()
    total = np.sum([np.frombuffer(p[0]).reshape(len(langs), SLOTS) for p in parts], axis=0)
    p = total / np.maximum(total.sum(1, keepdims=True), 1e-9) + 1e-6
    return langs, np.log(p / p.sum(1, keepdims=True))


def _share(by: list[str], pages: DataFrame, n: int, prefix: str) -> DataFrame:
    """Sums of the text posteriors by group, as an array."""
    return durable(pages.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias(prefix)))


def languages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host of each row of ``pages`` (page_id, url, html)."""
    langs, logp = fit(documents)
    n = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros((b.num_rows, n))
            for i, page in enumerate(b.column(3).to_pylist()):
                s = slots(visible(page))
                if len(s):
                    mean = logp[:, s].mean(1) if len(s) <= SLOTS else logp @ np.bincount(s, minlength=SLOTS) / len(s)
                    score[i] = mean * min(len(s) / 3, EFFECTIVE)
            score -= score.max(1, keepdims=True) if n else 0
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score.tolist(), pa.list_(pa.float64()))], names=["page_id", "host", "declared", "ll"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), LANG, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), declared.alias("declared"), "html").mapInArrow(run, "page_id long, host string, declared string, ll array<double>")
    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")

    return fused(rows, langs)


def fused(rows: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host of rows (page_id, host, declared, ll: log likelihood by language)."""
    n = len(langs)

    def softmax(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    labels = F.split("host", r"\.")
    rows = rows.withColumn("p", softmax(F.col("ll")))
    rows = rows.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.substring_index("host", ".", -2))
    rows = rows.withColumn("said", F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared") == "", F.lit("none")).otherwise(F.lit("other")))
    rows = durable(rows)
    total = rows.agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias("t")).first()["t"]
    if total[0] is None:
        total = [0.0] * n
    by_host = _share(["host", "domain", "suffix"], rows, n, "h")
    by_domain = _share(["domain"], by_host.select("domain", F.col("h").alias("p")), n, "d")
    by_suffix = _share(["suffix"], by_host.select("suffix", F.col("h").alias("p")), n, "s")
    said = {r["said"]: r["c"] for r in rows.groupBy("said").agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias("c")).collect()}
    kinds = [*langs, "none", "other"]
    # P(declared | language), a page that declares its own language being likely beforehand
    counts = np.array([[said.get(x, [0.0] * n)[k] + (5.0 if x == lang else 0.5) for x in kinds] for k, lang in enumerate(langs)])
    logd = np.log(counts / counts.sum(1, keepdims=True))
    declares = F.create_map(*[x for j, kind in enumerate(kinds) for x in (F.lit(kind), F.array(*[F.lit(float(logd[k, j])) for k in range(n)]))])

    # a host's languages, then its domain's, then its suffix's, then all: each smooths the one before
    per_host = by_host.join(by_domain, "domain").join(by_suffix, "suffix").select("host", "h", "d", "s")
    rows = rows.join(durable(per_host), "host")
    whole = F.array(*[F.lit(float(t)) for t in total])

    def less_own(level: Column) -> Column:
        return F.zip_with(level, "p", lambda a, b: F.greatest(F.lit(0.0), a - b))

    def smoothed(level: Column, parent: Column) -> Column:
        mass = F.aggregate(level, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(level, parent, lambda a, b: (a + STRENGTH * b) / (mass + STRENGTH))

    rows = rows.withColumn("prior", smoothed(less_own(whole), F.array(*[F.lit(1.0 / n)] * n)))
    for level in ("s", "d", "h"):
        rows = rows.withColumn("prior", smoothed(less_own(F.col(level)), F.col("prior")))
    fused = F.zip_with(F.zip_with("ll", declares[F.col("said")], lambda a, b: a + b), "prior", lambda a, b: a + F.ln(b))
    rows = rows.withColumn("f", fused).withColumn("f", F.transform("f", lambda v: v - F.array_max("f"))).withColumn("post", softmax(F.col("f")))
    codes = F.array(*map(F.lit, langs))
    best = F.array_position("post", F.array_max("post")).cast("int")
    return rows.select("page_id", codes[best - 1].alias("lang"), F.array_max("post").alias("posterior"), codes[F.array_position("p", F.array_max("p")).cast("int") - 1].alias("text_lang"), "declared", "host")
