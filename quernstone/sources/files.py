"""Files as tables: scans with their rules, inventories, and parsing into content units."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import parsers

UNITS = "path string, ordinal int, parser string, unit_type string, title string, body string, locator string, status string, warning string"


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = (), excluded: Sequence[str] = (), max_bytes: int | None = None, settled_before: Column | None = None) -> DataFrame:
    """path, modificationTime, length, content, extension, skipped (null, or why a present file is passed over) of all files under root.

    excluded: regular expressions over paths. Skipped files are listed, so that they don't count as gone; their content is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    why = F.when(~ext.isin(list(extensions)), "extension") if extensions else F.when(F.lit(False), "")
    for pattern in excluded:
        why = why.when(F.col("path").rlike(pattern), "excluded")
    if max_bytes is not None:
        why = why.when(F.col("length") > max_bytes, "too_large")
    if settled_before is not None:
        why = why.when(F.col("modificationTime") > settled_before, "not_settled")
    return files.withColumns({"extension": ext, "skipped": why})


def inventory(files: DataFrame) -> DataFrame:
    """extension, files, bytes, skipped: one row for an extension."""
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"))


def hashed(files: DataFrame) -> DataFrame:
    return files.where("skipped is null").select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"), F.sha2("content", 256).alias("sha256"))


def parsed(files: DataFrame) -> DataFrame:
    """Content units of files (path, content, extension): the first parser for an extension; a failure is a row with its reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, content, ext in zip(frame["path"], frame["content"], frame["extension"], strict=True) for r in parsers.units(path, bytes(content), ext)]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "parser", "unit_type", "title", "body", "locator", "status", "warning"])

    return files.where("skipped is null").select("path", "content", "extension").mapInPandas(run, UNITS)


def xlsx_range(files: DataFrame, sheet: str, cells: str) -> DataFrame:
    """path, row, col, value, type, formula, merged (the range), hidden, filtered of the cells of a range (like A1:C9) in a sheet of each workbook."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *c) for path, content in zip(frame["path"], frame["content"], strict=True) for c in parsers.xlsx_cells(bytes(content), sheet, cells)]
            yield pd.DataFrame(rows, columns=["path", "row", "col", "value", "type", "formula", "merged", "hidden", "filtered"])

    return files.select("path", "content").mapInPandas(run, "path string, row int, col int, value string, type string, formula string, merged string, hidden boolean, filtered boolean")
