"""Listings in pages by cursor: stored in the order that they are read in, so that a page opens the files that it is in and no others.

A listing is written range by range, and what lies in each file (its first and last keys, its rows) is noted. A cursor holds the sort key of the last row that was
read: rows that are added or removed before it change nothing behind it, and the pages of a listing together are the whole listing. Added rows are files of their
own; a page takes what it needs of each such part. The key must tell rows apart.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import manifest

#: Rows in a file, about.
ROWS = 20_000


@dataclass(frozen=True)
class Listing:
    """Where a listing lies and its order: columns, with a minus before those that descend. Nulls come last."""

    spark: SparkSession
    root: str
    order: tuple[str, ...]

    def keys(self) -> list[tuple[str, bool]]:
        return [(c.lstrip("-"), c.startswith("-")) for c in self.order]

    def by(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in self.keys()]


def _plain(x: Any) -> Any:
    return x.isoformat() if isinstance(x, (date, datetime)) else str(x) if isinstance(x, Decimal) else x


def add(listing: Listing, rows: DataFrame, per_file: int = ROWS) -> None:
    """Adds rows, as a part of files of their own."""
    name, n = uuid.uuid4().hex, rows.count()
    if not n:
        return
    parts = -(-n // per_file)
    path = f"{listing.root}/rows/{name}"
    rows.repartitionByRange(parts, *listing.by()).sortWithinPartitions(*listing.by()).write.parquet(path)
    names = [c for c, _ in listing.keys()]
    key = F.struct(*names)
    # sorted files: their first and last rows, in the order in which they lie
    placed = listing.spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), key.alias("key"))
    files = placed.groupBy("file").agg(F.count("*").alias("n"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    files = files.select("file", "n", *[F.col(f"{e}.{c}").alias(f"{e}_{i}") for e in ("first", "last") for i, c in enumerate(names)])
    files.coalesce(1).write.parquet(f"{listing.root}/files/{name}")
    manifest.update(listing.spark, listing.root, lambda now: {"parts": [*now.get("parts", []), name]})


def _behind(listing: Listing, cursor: Sequence[Any], types: dict[str, str], prefix: str = "") -> Column:
    """Rows behind a cursor; with a prefix, files (their keys are prefix_0, ...) that end behind it."""
    out, equal = F.lit(False), F.lit(True)
    for i, ((c, down), x) in enumerate(zip(listing.keys(), cursor, strict=True)):
        col = F.col(f"{prefix}_{i}" if prefix else c)
        if x is None:
            equal = equal & col.isNull()  # nothing comes behind null
            continue
        v = F.lit(x).cast(types[c])
        out = out | (equal & ((col < v if down else col > v) | col.isNull()))
        equal = equal & (col == v)
    return out


def token(cursor: Sequence[Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps([_plain(x) for x in cursor]).encode()).decode()


def page(listing: Listing, limit: int, after: str | None = None, where: Column | None = None) -> tuple[DataFrame, str | None]:
    """The next ``limit`` rows behind a cursor, and the cursor behind them: None where nothing is left.

    Of each part the files are opened from the one that the cursor is in, until they have enough rows. With a filter more files are opened,
    twice as many each time, until the page is full or no file is left.
    """
    spark, names = listing.spark, [c for c, _ in listing.keys()]
    parts = manifest.latest(spark, listing.root).entries.get("parts", [])
    cursor = json.loads(base64.urlsafe_b64decode(after)) if after else None
    if not parts:
        raise ValueError("an empty listing")
    first = spark.read.parquet(f"{listing.root}/rows/{parts[0]}")
    types = dict(first.dtypes)
    queues = []
    for p in parts:
        files = spark.read.parquet(f"{listing.root}/files/{p}")
        if cursor is not None:
            files = files.where(_behind(listing, cursor, types, "last"))
        order = [F.col(f"first_{i}").desc_nulls_last() if down else F.col(f"first_{i}").asc_nulls_last() for i, (_, down) in enumerate(listing.keys())]
        # a page needs no more files than it has rows, and one for the cursor's own
        queues.append([(f"{listing.root}/rows/{p}/{r['file']}", r["n"]) for r in files.orderBy(*order).limit(limit + 1 if where is None else 1 << 30).select("file", "n").collect()])
    most = 1
    while True:
        opened = []
        for q in queues:
            have = 0
            for k, (file, n) in enumerate(q):
                if k and have >= limit * most:
                    break
                opened.append(file)
                # of the cursor's own file it isn't known how much is left
                have += 0 if k == 0 and cursor is not None else n
        rows = spark.read.schema(first.schema).parquet(*opened) if opened else first.limit(0)
        if cursor is not None:
            rows = rows.where(_behind(listing, cursor, types))
        found = (rows if where is None else rows.where(where)).orderBy(*listing.by()).limit(limit)
        if where is None or len(opened) == sum(map(len, queues)):
            break
        if found.count() == limit:
            break
        most *= 2
    last = found.select(*names).tail(1)
    full = bool(last) and found.count() == limit
    return found, token([last[0][c] for c in names]) if full else None
