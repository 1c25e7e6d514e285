"""Bytes that repeat: depth-limited radix passes over suffixes of documents, equal groups being the repeated windows.

A window is the string of DEPTH bytes at a place of a document. Groups of windows are refined digit by digit, from the most significant digit
on; a group of one is dropped at once, no pass looks beyond DEPTH bytes, and what is together after the last one are exactly the repeated
windows. The order of significance is from a window's anchor outwards, not from left to right: the anchor's 32 bytes, then what all windows of a
block share (169 bytes for blocks of 32 windows, 197 for 4), then all 200. Neighbouring windows share these digits, so that a pass has a row for
each block. Passes from left to right would need a row for each byte of the corpus in the first of them: README has the figures.

1. The first digit of a window is its least k-mer (by hash, the leftmost if alike). Neighbouring windows share it; a run
   of windows with the same one is one row: about one row in a hundred windows. Windows can only be equal if their first
   digits are, at the same offset.
2. Runs that are alike as a whole (all their bytes) are groups of equal windows: they are done. Runs whose first digit
   nobody shares are alone: done too.
3. What is left, mostly runs in which a repeated passage begins or ends, is cut by further passes into parts of 32, 4 and
   1 windows at fixed offsets from the k-mer. A part is done if all its bytes are found again, dropped if the bytes
   that all its windows share are not, and else cut finer. The last pass compares whole windows. One of each group that
   is done goes on beside those that are not, as what they may equal.

Every pass counts hashes (128 bits with the first digit) by partial aggregation, and joins the counts back; no group of equal
windows is ever gathered, so that a passage which a third of all documents share is as good as any.

Defined cases: a null text is empty; documents shorter than the depth have no windows; matches never cross documents, but
may overlap in one; repeated rows are documents of their own that match each other; a null doc_id is a document
like any other; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import durable

DEPTH, KMER = 200, 32
#: Bytes looked at together: bounds memory on long texts.
SEGMENT = 1 << 20
#: Windows in a part, pass by pass.
PARTS = (32, 4, 1)
_POS = (1 << 24) - 1


def _kmers(raw: bytes) -> np.ndarray:
    """A hash of the KMER bytes at each place."""
    n = len(raw) - 7
    x = np.empty(n, np.uint64)
    for r in range(8):
        m = len(x[r::8])
        x[r::8] = np.frombuffer(raw, "<u8", m, r)
    n -= KMER - 8
    h = np.zeros(n, np.uint64)
    for r in range(0, KMER, 8):
        h += x[r : r + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(raw: bytes, ends: list[int], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first window, last window, k-mer place, k-mer hash) arrays of all runs in documents laid end to end.

    ends: where each document ends. Long stretches go in segments; a run over a segment's edge gives two runs.
    """
    width = depth - KMER + 1
    ends_ = np.asarray(ends, np.int64)
    starts_ = np.concatenate(([0], ends_[:-1])).astype(np.int64)
    for at in range(0, max(0, len(raw) - depth + 1), SEGMENT):
        part = raw[at : at + SEGMENT + depth - 1]
        h = _kmers(part)
        key = (h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - width + 1
        pad = -len(key) % width
        blocks = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        place = (least & np.uint64(_POS)).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        lo, hi = np.maximum(starts_ - at, 0), np.minimum(ends_ - at - depth + 1, n)
        own = hi > lo
        np.add.at(valid, lo[own], 1)
        np.add.at(valid, hi[own], -1)
        place[np.cumsum(valid[:-1]) == 0] = -1
        cut = np.nonzero(place[1:] != place[:-1])[0] + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [n])) - 1
        p = place[first]
        keep = p >= 0
        first, last, p = first[keep], last[keep], p[keep]
        yield np.searchsorted(ends_, first + at, side="right"), first + at, last + at, p + at, h[p].view(np.int64)


def _laid(col: pa.Array) -> tuple[bytes, list[int]]:
    """All texts of a batch end to end, and where each ends."""
    texts = [x.as_py() for x in col]
    raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    return b"".join(raws), np.cumsum([len(r) for r in raws]).tolist()


def key() -> Column:
    """Tells documents apart; rows alike in doc_id and text share it."""
    return F.xxhash64(F.col("doc_id"), F.length("text"), F.col("text")).alias("k")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", key(), "text")


def _scan(docs: DataFrame, depth: int) -> DataFrame:
    """First pass: k, first, last, place, a (hash of the first digit), e (hash of all bytes) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, ends = _laid(b.column(1))
            k, at = b.column(0).to_numpy(), np.concatenate(([0], ends))
            digest = xxhash.xxh3_64_intdigest
            for d, first, last, place, a in runs(raw, ends, depth):
                e = np.array([digest(raw[x : y + depth]) for x, y in zip(first.tolist(), last.tolist(), strict=True)], np.uint64).view(np.int64)
                cols = [k[d], *((z - at[d]).astype(np.int32) for z in (first, last, place)), a, e]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "first", "last", "place", "a", "e"])

    return docs.select("k", "text").mapInArrow(run, "k long, first int, last int, place int, a long, e long")


_RANGE = "array<struct<lo:int,hi:int,want:boolean>>"
_ARROW_RANGE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("want", pa.bool_())]))


def _contexts(docs: DataFrame, still: DataFrame, depth: int) -> DataFrame:
    """The bytes of runs that go on: k, first, place, a, ctx, still (ranges of offsets, and whether they want an answer)."""
    lists = still.groupBy("k").agg(F.collect_set(F.struct("first", "last", "place", "a", "want")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in own:
                    first, last, place = r["first"], r["last"], r["place"]
                    out.append((k, first, place, r["a"], raw[first : last + depth], [{"lo": place - last, "hi": place - first, "want": r["want"]}]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["k", "first", "place", "a", "ctx", "still"])

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), _ARROW_RANGE]
    return docs.select("k", "text").join(lists, "k").mapInArrow(run, f"k long, first int, place int, a long, ctx binary, still {_RANGE}")


def _parts(contexts: DataFrame, size: int, depth: int) -> DataFrame:
    """k, first, place, a, want, lo, hi, e (hash of a part's bytes), c (hash of what all windows of its block share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for k, first, place, a, ctx, still in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = place - first  # of the k-mer in ctx
                for r in still:
                    for block in range(r["lo"] // size, r["hi"] // size + 1):
                        lo, hi = max(r["lo"], block * size), min(r["hi"], block * size + size - 1)
                        end = block * size + size - 1
                        core = ctx[at - block * size : at - end + depth]
                        own = ctx[at - hi : at - lo + depth]
                        for col, v in zip(cols, (k, first, place, a, r["want"], lo, hi, digest(own), digest(core, block + 1)), strict=True):
                            col.append(v)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)] + [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[7:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "first", "place", "a", "want", "lo", "hi", "e", "c"])

    return contexts.select("k", "first", "place", "a", "ctx", "still").mapInArrow(run, "k long, first int, place int, a long, want boolean, lo int, hi int, e long, c long")


def repeated(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(k, start, end): byte ranges that repeated windows cover, overlaps and doubles among them; docs as ``_keyed`` gives them."""
    rows = _scan(docs, depth)
    alike = durable(rows.groupBy("a", "e").agg(F.count("*").alias("n"), F.min(F.struct("k", "first")).alias("rep")))
    shared = durable(alike.groupBy("a").agg(F.sum("n").alias("m"), F.max(F.col("n") == 1).alias("open")).where("m > 1").select("a", "open"))
    alike = durable(alike.join(shared, "a").select("a", "e", (F.col("n") > 1).alias("full"), "open", F.when(F.col("n") > 1, F.col("rep")).alias("rep")))
    hit = durable(rows.join(alike, ["a", "e"]).select("k", "first", "last", "place", "a", "full", (F.col("open") & (~F.col("full") | (F.struct("k", "first") == F.col("rep")))).alias("goes_on")))
    found = hit.where("full").select("k", F.col("first").alias("start"), (F.col("last") + depth).alias("end"))
    contexts = durable(_contexts(docs, hit.where("goes_on").withColumn("want", ~F.col("full")), depth))
    still = contexts
    for n, size in enumerate(PARTS):
        parts = durable(_parts(still, size, depth))
        whole = durable(parts.groupBy("a", "e").agg(F.count("*").alias("n"), F.min(F.struct("k", "first", "place")).alias("rep")))
        parts = durable(parts.join(whole, ["a", "e"]).select("k", "first", "place", "a", "want", "lo", "hi", "c", "n", (F.struct("k", "first", "place") == F.col("rep")).alias("is_rep")))
        found = found.unionByName(parts.where("want and n > 1").select("k", (F.col("place") - F.col("hi")).alias("start"), (F.col("place") - F.col("lo") + depth).alias("end")))
        if n + 1 < len(PARTS):
            wanted = F.col("want") & (F.col("n") == 1)
            core = durable(parts.groupBy("a", "c").agg(F.count("*").alias("m"), F.max(wanted).alias("open")).where("m > 1 and open").select("a", "c"))
            on = parts.where("n = 1 or is_rep").join(core, ["a", "c"]).select("k", "first", "place", F.struct("lo", "hi", wanted.alias("want")).alias("r"))
            still = contexts.drop("still").join(on.groupBy("k", "first", "place").agg(F.collect_set("r").alias("still")), ["k", "first", "place"])
    return found


def cut(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of each row of ``docs``."""
    keyed = _keyed(docs)
    spans = repeated(keyed, depth).groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, n = [], 0, 0
                for s in sorted((x["start"], x["end"]) for x in own or []):
                    if s[0] > at or not n:
                        kept.append(raw[at : s[0]])
                        n += 1
                    at = max(at, s[1])
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    joined = keyed.join(spans, "k", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The same in DuckDB, by a hash of every window; fine for small tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
m AS MATERIALIZED (SELECT r, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
s AS (SELECT r, i FROM m SEMI JOIN (SELECT k FROM m GROUP BY k HAVING count(*) > 1) g USING (k)),
b AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM s),
p AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM b),
c AS (SELECT r, n, min(i) AS a, max(i) + 200 AS z FROM p GROUP BY r, n),
l AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM c),
k AS (SELECT r, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS tail FROM l JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
