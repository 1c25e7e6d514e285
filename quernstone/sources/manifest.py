"""Versioned tables: each version is a small manifest of what is live, and becomes current only if nobody else has made that version.

Files are written beside the live ones first and named in the next manifest afterwards, so that a reader sees one version whole, never a part of
two. A manifest comes to be under its number by one step that fails if the number is taken: a hard link on a local disk, a rename elsewhere (file systems whose
rename replaces files, as some object stores' does, give no such step). A writer that comes second reads the new version and tries again, or gets a Conflict.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    entries: dict[str, Any] = field(default_factory=dict)


def _folder(spark: SparkSession, root: str):
    """The folder of manifests and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{FOLDER}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(number: int) -> str:
    return f"{number:012d}.json"


def latest(spark: SparkSession, root: str) -> Version:
    """The current version; version 0, without entries, where there is none."""
    path, fs = _folder(spark, root)
    if not fs.exists(path):
        return Version()
    numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")]
    return at(spark, root, max(numbers)) if numbers else Version()


def at(spark: SparkSession, root: str, number: int) -> Version:
    jvm = spark.sparkContext._jvm
    path, fs = _folder(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, _name(number)))
    try:
        return Version(number, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, base: Version, entries: dict[str, Any]) -> Version:
    """Makes the version after ``base``; entries that are what they were make none. Conflict if there is one already."""
    if entries == base.entries and base.number:
        return base
    jvm = spark.sparkContext._jvm
    path, fs = _folder(spark, root)
    fs.mkdirs(path)
    draft, final = (jvm.org.apache.hadoop.fs.Path(path, n) for n in (f".{uuid.uuid4().hex}", _name(base.number + 1)))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError as e:
                raise Conflict(_name(base.number + 1)) from e
        elif fs.exists(final) or not fs.rename(draft, final):
            raise Conflict(_name(base.number + 1))
    finally:
        fs.delete(draft, False)
    return Version(base.number + 1, entries)


def update(spark: SparkSession, root: str, change: Callable[[dict[str, Any]], dict[str, Any]], tries: int = 8) -> Version:
    """Commits what ``change`` makes of the current entries; asked again with the new ones each time another writer was first."""
    for k in range(tries):
        base = latest(spark, root)
        try:
            return commit(spark, root, base, change(json.loads(json.dumps(base.entries))))
        except Conflict:
            if k + 1 == tries:
                raise
            time.sleep(0.01 * 2**k)
    raise AssertionError


def expire(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Removes all manifests but the last ``keep``; returns their numbers. Folders that none names any more are the caller's to delete."""
    path, fs = _folder(spark, root)
    last = latest(spark, root).number
    gone = [n for n in range(max(1, last - 2 * keep - 1000), last - keep + 1) if fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, _name(n)), False)]
    return gone
