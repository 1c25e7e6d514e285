"""Fuzzy similarity of strings, in Arrow batches: Spark has no such function of its own.

An approximation of the usual weighted ratio: indel similarity of the strings, of their sorted words, and of their word sets. Strings are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quernstone.operators.lexical import ranked

_WORD = re.compile(r"[^\W_]+")
#: Places of the longer string that are compared at a time.
BITS = 1 << 14


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, of whole strings: bit-parallel, BITS places of the longer one at a time, for each character of the shorter."""
    a, b = sorted((a, b), key=len)
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    carried, found = [0] * len(a), 0
    for at in range(0, len(b), BITS):
        part = codes[at : at + BITS]
        places = {c: int.from_bytes(np.packbits(part == ord(c), bitorder="little").tobytes(), "little") for c in set(a) & set(b[at : at + BITS])}
        full = (1 << len(part)) - 1
        s = full
        for i, c in enumerate(a):
            u = places.get(c, 0) & s
            if u or carried[i]:
                t = s + u + carried[i]
                # what a sum carries goes on into the next places
                carried[i] = t >> len(part)
                s = (t | (s - u)) & full
        found += len(part) - s.bit_count()
    return found


def indel(a: str, b: str) -> float:
    """1 - insertions and deletions by the sum of lengths: twice the longest common subsequence by it."""
    return 2.0 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str, b: str) -> float:
    x, y = set(_WORD.findall(a.lower())), set(_WORD.findall(b.lower()))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z - (x & y)))))) for z in (x, y))
    if both and (x <= y or y <= x):
        return 1.0
    # both begins left and right, so that it is what it has in common with either
    return max(indel(left, right), *(2.0 * len(both) / (len(both) + len(z)) for z in (left, right)))


def similarity(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    ordered = indel(" ".join(sorted(_WORD.findall(a.lower()))), " ".join(sorted(_WORD.findall(b.lower()))))
    return max(indel(a.lower(), b.lower()), 0.95 * ordered, token_set(a, b)) if a and b else 0.0


@F.pandas_udf(DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_rerank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, index, score, rank: 0.85 of the similarity and 0.15 by the candidate's place before."""
    score: Column = fuzzy("query", "document") * 0.85 + 0.15 / (F.col("index") + 1)
    return ranked(candidates.join(queries, "query_id").select("query_id", "index", F.round(score, 6).alias("score")), None, "index")
