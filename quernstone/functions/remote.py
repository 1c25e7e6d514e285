"""Model services over HTTP, called from tasks: a bounded number of requests in flight, retries, answers that are checked before they count.

A task sends its rows in requests of a few texts each and keeps at most IN_FLIGHT of them on their way, so that it waits for the service and not
between requests, and holds no more than these. A request that is refused for the moment (429, 5xx, no connection) is sent again after a pause that doubles, with the
same idempotency key, as is one of a task that runs again. What still fails doesn't fail the job: its rows have a reason instead of an answer, and
searches go on without it, flagged as degraded.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import math
import time
from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.parse import urlparse
from urllib.request import ProxyHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.ranking import ranked

#: Texts of a request, requests of a task on their way, attempts, and the first pause in seconds.
BATCH, IN_FLIGHT, TRIES, PAUSE = 64, 4, 4, 0.2


class Unavailable(RuntimeError):
    pass


def allowed(url: str, remote: bool = False) -> str:
    """A base URL that may be called: HTTP, without credentials, and on this machine unless remote services are allowed."""
    p = urlparse(url)
    if p.scheme not in ("http", "https") or not p.hostname or p.username or p.password:
        raise ValueError("a model service needs an absolute HTTP address without credentials")
    try:
        own = ipaddress.ip_address(p.hostname).is_loopback
    except ValueError:
        own = p.hostname.lower() == "localhost"
    if not (own or remote):
        raise ValueError("remote model services aren't allowed here")
    return url.rstrip("/")


@dataclass(frozen=True)
class Service:
    """Where a model answers, and how it is called."""

    url: str
    model: str
    remote: bool = False
    timeout: float = 30.0
    tries: int = TRIES
    pause: float = PAUSE

    def post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        data = json.dumps({"model": self.model, **body}).encode()
        request = Request(f"{allowed(self.url, self.remote)}/{path}", data, {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(data).hexdigest()})
        opener = build_opener(ProxyHandler({}))
        for k in range(self.tries):
            try:
                with opener.open(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except HTTPError as e:
                reason, again = f"HTTP {e.code}", e.code == 429 or e.code >= 500
            except (URLError, TimeoutError, ConnectionError) as e:
                reason, again = str(getattr(e, "reason", e)), True
            except ValueError as e:
                reason, again = f"no JSON: {e}", False
            if not again or k + 1 == self.tries:
                raise Unavailable(reason)
            time.sleep(self.pause * 2**k)
        raise Unavailable("not called")


def vectors(answer: dict[str, Any], n: int, dimensions: int) -> list[list[float]]:
    """The embeddings of an answer in the order of its texts; ValueError if there aren't n of them, all finite and of the dimension."""
    rows = sorted(answer["data"], key=lambda r: int(r["index"]))
    out = [[float(x) for x in r["embedding"]] for r in rows]
    if [int(r["index"]) for r in rows] != list(range(n)):
        raise ValueError("answers don't match the texts")
    if any(len(v) != dimensions for v in out):
        raise ValueError(f"an embedding hasn't {dimensions} dimensions")
    if not all(math.isfinite(x) for v in out for x in v):
        raise ValueError("an embedding isn't finite")
    return out


def scores(answer: dict[str, Any], n: int) -> list[float]:
    """The scores of an answer in the order of its documents; ValueError if one is missing or not finite."""
    found = {int(r["index"]): float(r["relevance_score"]) for r in answer["results"]}
    if found.keys() != set(range(n)) or not all(map(math.isfinite, found.values())):
        raise ValueError("scores don't match the documents")
    return [found[i] for i in range(n)]


def _in_flight(calls: Iterator[tuple[Any, Any]], most: int) -> Iterator[tuple[Any, Any, str | None]]:
    """(what, answer, error) of (what, function) in their order, at most ``most`` of them running."""
    with ThreadPoolExecutor(most) as pool:
        waiting: deque[tuple[Any, Future]] = deque()

        def first() -> tuple[Any, Any, str | None]:
            what, future = waiting.popleft()
            try:
                return what, future.result(), None
            except (Unavailable, ValueError, KeyError, TypeError) as e:
                return what, None, f"{type(e).__name__}: {e}"[:300]

        for what, f in calls:
            if len(waiting) == most:
                yield first()
            waiting.append((what, pool.submit(f)))
        while waiting:
            yield first()


def embedded(texts: DataFrame, service: Service, dimensions: int, key: str = "unit_id", instruction: str = "", batch: int = BATCH, in_flight: int = IN_FLIGHT) -> DataFrame:
    """key, embedding, error of each row of ``texts`` (key, text): either an embedding or why there is none. Null texts are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def calls() -> Iterator[tuple[Any, Any]]:
            for b in batches:
                for a in range(0, b.num_rows, batch):
                    part = b.slice(a, batch)
                    own = [instruction + (x or "") for x in part.column(1).to_pylist()]
                    yield part.column(0), lambda own=own: vectors(service.post("embeddings", {"input": own}), len(own), dimensions)

        for keys, found, error in _in_flight(calls(), in_flight):
            n = len(keys)
            yield pa.RecordBatch.from_arrays([keys, pa.array(found or [None] * n, pa.list_(pa.float64())), pa.array([error] * n, pa.string())], names=[key, "embedding", "error"])

    schema = T.StructType([texts.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    return texts.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def reranked(candidates: DataFrame, queries: DataFrame, service: Service, most: int = 100, in_flight: int = IN_FLIGHT) -> DataFrame:
    """query_id, index, score, rank, degraded of candidates (query_id, index, document), by a model's relevance scores.

    A query's first ``most`` candidates by index are one request. If it fails, or for candidates beyond, the order is that of index: score is null then, and
    degraded says that the model gave none.
    """
    head = candidates.where(F.col("index") < most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "document"))).alias("own"))
    asked = head.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", F.col("own.index").alias("at"), F.col("own.document").alias("documents"))
    kinds = {c: candidates.schema[c].dataType for c in ("query_id", "index")}
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("index", kinds["index"]), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def calls() -> Iterator[tuple[Any, Any]]:
            for b in batches:
                for i in range(b.num_rows):
                    query, documents = b.column(1)[i].as_py(), [x or "" for x in b.column(3)[i].as_py()]
                    yield (b.column(0).slice(i, 1), b.column(2)[i].values), lambda q=query, d=documents: scores(service.post("rerank", {"query": q, "documents": d}), len(d))

        for (ids, at), found, error in _in_flight(calls(), in_flight):
            if error is None:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([0] * len(at))), at, pa.array(found, pa.float64())], names=["query_id", "index", "score"])

    given = asked.mapInArrow(run, schema)
    out = candidates.select("query_id", "index").join(given, ["query_id", "index"], "left")
    scored = out.withColumn("_order", F.coalesce("score", F.lit(float("-inf"))))
    return ranked(scored, None, "index", score="_order").drop("_order").withColumn("degraded", F.col("score").isNull() & (F.col("index") < most))
