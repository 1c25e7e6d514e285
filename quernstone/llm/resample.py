"""Importance resampling towards a target: documents drawn by how much likelier their word features are in a target set.

Features are runs of one to ``longest`` consecutive words, hashed to BUCKETS buckets. A bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus, a document's weight the sum of its features' gains, and its score the weight plus Gumbel noise from its doc_id:
the highest scores are a draw without replacement in proportion to the exponentials of weights.

Long texts are cut into chunks at word boundaries, so that one of them doesn't keep a task busy alone. A chunk owns the features that start in
it, and carries the ``longest`` - 1 words behind it to complete them. Chunks are dealt out anew; their numbers of features and weights are summed
by document. Short texts are one chunk each and don't move. What is kept of a text in between are its buckets, two bytes for each feature.

Ranks come from a range-partitioned sort of the scores, a count for each partition, and places within it: no task orders all documents.

Defined cases: a null text has no words; texts without words have no features and weight 0; fewer words than ``least`` are not drawn; a null doc_id is
hashed as an empty one and drawn like others; rows that repeat a doc_id are documents of their own, alike in noise, and tie by doc_id and then by the order of
reading; a word of any length is one word, and ends its chunk; an empty target smooths all buckets alike; an empty table gives an
empty result. Columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import durable

LONGEST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text that a chunk owns; texts of up to twice as many are one chunk.
CHUNK = 1 << 17
#: What words are made of, in lower-cased UTF-8. Bytes from 128 on belong to other letters and signs.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def chunks(text: bytes, longest: int = LONGEST, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(piece, own) of a lower-cased text: bytes of a chunk with its carry, and how many of them the chunk owns."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and (m := WORD.match(text, end)):
            end = m.end()
        stop = end
        for _ in range(longest - 1):
            m = WORD.search(text, stop)
            if not m:
                break
            stop = m.end()
        yield text[at:stop], end - at
        at = end


def features(piece: bytes, own: int, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words start among the first ``own`` bytes of a piece, and the buckets of the features that start with them."""
    mine = WORD.findall(piece[:own])
    n = len(mine)
    if longest == 1:
        return n, (np.fromiter(map(zlib.crc32, mine), np.uint32, n) % buckets).astype(np.int32)
    words = mine + WORD.findall(piece, own)
    out = []
    for m in range(1, longest + 1):
        runs = [b" ".join(words[i : i + m]) for i in range(min(n, len(words) - m + 1))]
        out.append((np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % buckets).astype(np.int32))
    return n, np.concatenate(out)


def _kept(buckets: int):
    """Two bytes hold a bucket of up to 65,536."""
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def hashed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, found): of each chunk the row it is from (null: the only chunk), its words, and its features' buckets."""
    kind = _kept(buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    long = F.coalesce(F.octet_length("text") > 2 * CHUNK, F.lit(False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                for k, (piece, own) in enumerate(chunks(text.as_py().lower(), longest)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([doc_id.as_py()], pa.int64()), pa.array([piece], pa.binary()), pa.array([own], pa.int32())], names=["row", "k", "doc_id", "text", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, found = [], []
            for text, own in zip(b.column(2), b.column(3), strict=True):
                text, own = (text.as_py() or b"").lower(), own.as_py()
                n, f = features(text, len(text) if own is None else own, longest, buckets)
                words.append(n)
                found.append(f.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(found, pa.binary())], names=["row", "doc_id", "n_words", "found"])

    one = rows.where(~long).select(F.lit(None).cast("long").alias("row"), "doc_id", "text", F.lit(None).cast("int").alias("own"))
    several = rows.withColumn("row", F.monotonically_increasing_id()).where(long).select("row", "doc_id", "text")
    dealt = several.mapInArrow(cut, "row long, k int, doc_id long, text binary, own int").repartition("row", "k").drop("k")
    schema = "row long, doc_id long, n_words long, found binary"
    return one.mapInArrow(run, schema).unionByName(dealt.mapInArrow(run, schema))


def histogram(chunked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: tasks count their chunks, the driver gets a number for each bucket."""
    kind = _kept(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        some = np.nonzero(n)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in chunked.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's shares, one added to each count."""
    s, t, b = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of ``docs``."""
    kind = _kept(buckets)
    chunked = durable(hashed(docs, longest, buckets))
    gain = gains(histogram(chunked, buckets), histogram(hashed(target.select(F.lit(None).alias("doc_id"), "text"), longest, buckets), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_py(), kind) for x in b.column(3)]
            sums = [pa.array([f(x) for x in own], pa.int64()) for f in (len, lambda x: int(gain[x].sum()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *sums], names=["row", "doc_id", "n_words", "n_features", "weight"])

    parts = chunked.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")
    names = ("n_words", "n_features", "weight")
    long = parts.where("row is not null").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names]).drop("row")
    return parts.where("row is null").drop("row").unionByName(long)


def numbered(rows: DataFrame, *order) -> tuple[DataFrame, int]:
    """``rows`` with place, from 1 in the given order over all of them, and their number."""
    # ids within a sorted partition ascend by one from a multiple of 2 ** 33
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    sorted_ = durable(tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row for each partition of the sort
    before = durable(sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    total = before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = sorted_.withColumn("part", part).join(before.select("part", "before"), "part")
    return placed.withColumn("place", F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "at"), total


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` (doc_id, text); rank: of those drawn, else null. target: (text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = durable(weighed(docs, target, longest, buckets).withColumn("score", (F.col("weight") + noise).cast("long")))
    fields = ["doc_id", "n_features", "weight", "score"]
    placed, n = numbered(scored.where(F.col("n_words") >= least).select(*fields), F.desc("score"), F.asc("doc_id"))
    drawn = placed.select(*fields, F.when(F.col("place") <= percent * n // 100, F.col("place")).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least).select(*fields, F.lit(None).cast("long").alias("rank")))


ORACLE = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), tot),
wt AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
sc AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
