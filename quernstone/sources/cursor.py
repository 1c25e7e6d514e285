"""A streaming source for services that are pulled by cursor: what has come since the last pull.

Register with spark.dataSource.register(CursorSource) and read with format("cursor") and option("path", ...): files of JSON lines with
uid, and the thread, text and deletion of a message, which pullers add whole lines or files to. The offset is how far each file has been read;
the driver only looks at sizes, and each file's new lines are a task's to read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "uid bigint, thread string, text string, deleted boolean"


@dataclass
class NewLines(InputPartition):
    path: str
    start: int
    end: int


class CursorReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p.name: p.stat().st_size for p in sorted(Path(self.path).glob("*.jsonl"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [NewLines(f"{self.path}/{name}", start.get(name, 0), size) for name, size in end.items() if size > start.get(name, 0)]

    def read(self, partition: NewLines) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            while f.tell() < partition.end and (line := f.readline()):
                if line.strip():
                    m = json.loads(line)
                    yield m["uid"], m.get("thread"), m.get("text"), bool(m.get("deleted"))

    def commit(self, end: dict) -> None:
        pass


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(self.options["path"])


def threads(messages: DataFrame) -> DataFrame:
    """thread, body, n, is_deleted: messages (uid, thread, text, deleted) of a thread as one event; it is gone once all are."""
    last = messages.groupBy("thread", "uid").agg(F.max("deleted").alias("deleted"), F.max("text").alias("text"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("deleted"), F.struct("uid", "text"))))
    return last.groupBy("thread").agg(kept.alias("m")).select("thread", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("body"), F.size("m").alias("n"), (F.size("m") == 0).alias("is_deleted"))
