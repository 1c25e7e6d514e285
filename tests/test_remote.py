"""Model services against a local server that is slow, refuses, and gives wrong answers."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quernstone.functions import remote


class Server(BaseHTTPRequestHandler):
    seen, flying, most, lock = {}, 0, 0, threading.Lock()

    def log_message(self, *a):
        pass

    def do_POST(self):
        s = Server
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with s.lock:
            s.flying += 1
            s.most = max(s.most, s.flying)
            key = self.headers["Idempotency-Key"]
            s.seen[key] = s.seen.get(key, 0) + 1
            tries = s.seen[key]
        time.sleep(0.01)
        code, out = 200, {}
        if self.path.endswith("embeddings"):
            texts = body["input"]
            if any("busy" in t for t in texts) and tries < 3:
                code = 503
            elif any("wrong" in t for t in texts):
                out = {"data": [{"index": 0, "embedding": [1.0]}]}
            elif any("never" in t for t in texts):
                code = 400
            else:  # in another order than asked
                out = {"data": [{"index": i, "embedding": [float(len(t)), float(i), 1.0]} for i, t in reversed(list(enumerate(texts)))]}
        elif "down" in body["query"]:
            code = 500
        else:
            out = {"results": [{"index": i, "relevance_score": float(d.count(body["query"]))} for i, d in reversed(list(enumerate(body["documents"])))]}
        data = json.dumps(out).encode()
        with s.lock:
            s.flying -= 1
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield remote.Service(f"http://127.0.0.1:{server.server_port}/v1/", "m", pause=0.01)
    server.shutdown()


def test_embeddings_in_order_with_retries(spark, service):
    rows = [(i, "x" * (i % 9) + (" busy" if i % 20 == 0 else "")) for i in range(100)] + [(500, None)]
    df = spark.createDataFrame(rows, "unit_id long, text string").coalesce(1)
    Server.most = 0
    got = {r["unit_id"]: r for r in remote.embedded(df, service, 3, instruction="q: ", batch=8, in_flight=3).collect()}
    assert all(got[i]["error"] is None and got[i]["embedding"][0] == len("q: " + (t or "")) for i, t in rows)
    assert 1 < Server.most <= 3


def test_what_fails_has_a_reason(spark, service):
    rows = [(1, "fine"), (2, "wrong"), (3, "never"), (4, "busy but in time")]
    got = {r["unit_id"]: (r["embedding"], r["error"]) for r in remote.embedded(spark.createDataFrame(rows, "unit_id long, text string").coalesce(1), service, 3, batch=1).collect()}
    assert got[1][0] == [4.0, 0.0, 1.0] and got[4][1] is None
    assert got[2][0] is None and "dimensions" in got[2][1] and got[3][0] is None and "400" in got[3][1]
    gone = remote.Service("http://127.0.0.1:9", "m", tries=2, pause=0.01)
    assert remote.embedded(spark.createDataFrame(rows, "unit_id long, text string"), gone, 3).where("error is not null").count() == 4


def test_reranking_falls_back_to_the_given_order(spark, service):
    c = spark.createDataFrame([(q, i, d) for q in (1, 2) for i, d in enumerate(["a", "aa b", None, "aaa"])], "query_id long, index int, document string")
    q = spark.createDataFrame([(1, "a"), (2, "down")], "query_id long, query string")
    got = {k: [(r["index"], r["score"], r["degraded"]) for r in remote.reranked(c, q, service, most=3).where(f"query_id = {k}").orderBy("rank").collect()] for k in (1, 2)}
    assert got[1] == [(1, 2.0, False), (0, 1.0, False), (2, 0.0, False), (3, None, False)]
    assert got[2] == [(0, None, True), (1, None, True), (2, None, True), (3, None, False)]


def test_answers_and_addresses_are_checked():
    one = lambda i, v: {"data": [{"index": i, "embedding": v}]}
    for bad in (one(1, [1.0]), one(0, [1.0, 2.0]), one(0, [float("nan")]), {"data": []}):
        with pytest.raises(ValueError):
            remote.vectors(bad, 1, 1)
    with pytest.raises(ValueError):
        remote.scores({"results": [{"index": 0, "relevance_score": 1.0}]}, 2)
    for bad in ("http://model.example", "ftp://127.0.0.1", "http://u:p@127.0.0.1", "127.0.0.1"):
        with pytest.raises(ValueError):
            remote.allowed(bad)
    assert remote.allowed("http://model.example/", remote=True) == "http://model.example" and remote.allowed("http://localhost:1")
