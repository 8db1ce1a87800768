"""Encoders and models behind HTTP, against a local stub."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from litspark.operators import extract
from litspark.sources import services as S
from pyspark.sql import functions as F


class Stub(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    calls: Counter = Counter()
    fail_first: dict = {}
    clients: set = set()

    def log_message(self, *args):
        pass

    def answer(self, status, content):
        body = json.dumps(content).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        if status == 429:
            self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self.answer(200, {"models": [{"name": "Nomic-embed:latest"}, {"name": ""}, {}]})

    def do_POST(self):
        Stub.calls[self.path] += 1
        Stub.clients.add(self.client_address)
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Stub.fail_first.get(self.path, 0) > 0:
            Stub.fail_first[self.path] -= 1
            return self.answer(429, {})
        vector = lambda t: [0.0, 0.0, 0.0] if t == "zero" else [float(len(t)), 1.0, 2.0]
        if self.path == "/api/embed":
            if any("bad" in t for t in asked["input"]):
                return self.answer(400, {"error": "bad batch"})
            return self.answer(200, {"embeddings": [vector(t) for t in asked["input"]]})
        if self.path == "/api/embeddings":
            return self.answer(400, {}) if asked["prompt"] == "worst bad" else self.answer(200, {"embedding": vector(asked["prompt"])})
        if self.path == "/api/generate":
            if "broken" in asked["prompt"]:
                return self.answer(500, {})
            words = asked["prompt"].split()[:2]
            return self.answer(200, {"response": json.dumps({"concepts": ["c"], "evidence": [" ".join(words)], "confidence": 0.5}), "eval_count": 7, "prompt_eval_count": len(asked["prompt"])})
        return self.answer(404, {})


@pytest.fixture
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    server.daemon_threads = True
    Stub.calls, Stub.fail_first, Stub.clients = Counter(), {}, set()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_driver_questions(url):
    assert S.list_models(url) == ["Nomic-embed:latest"] and S.check_connection(url) and S.is_installed(url, " nomic ") and not S.is_installed(url, "llama")
    assert S.dimension(url, "m") == 3
    gone = "http://127.0.0.1:9"
    assert S.list_models(gone) == [] and not S.check_connection(gone) and S.dimension(gone, "m", 0.2) == S.DIMENSION


def test_encode_in_batches_with_fall_back(spark, url):
    texts = ["abc", None, "zero", "", "abc", "a bad one", "worst bad"] + [f"text {i:03d}" for i in range(57)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = {r.id: r for r in S.encode(df, url, "m", batch=16, pause=0.01).collect()}
    unit = lambda t: np.array([len(t), 1, 2]) / np.linalg.norm([len(t), 1, 2])
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].embedding is None and rows[i].embedding_error is None
        elif t == "worst bad":
            assert rows[i].embedding is None and "400" in rows[i].embedding_error
        else:
            np.testing.assert_allclose(rows[i].embedding, [0, 0, 0] if t == "zero" else unit(t), atol=1e-6)
    assert Stub.calls["/api/embed"] == 4 and Stub.calls["/api/embeddings"] == 16  # 62 different texts; one batch in single requests
    assert len(Stub.clients) == 1  # one connection a task
    raw = S.encode(df.filter("id = 0"), url, "m", normalize=False).first()
    assert raw.embedding == [3.0, 1.0, 2.0]
    assert S.encode(df.limit(0), url, "m").collect() == []


def test_retries_and_lasting_failures(spark, url):
    Stub.fail_first = {"/api/embed": 2}
    df = spark.createDataFrame([("a",)], "text string")
    assert S.encode(df, url, "m", pause=0.01).first().embedding is not None and Stub.calls["/api/embed"] == 3
    row = S.encode(df, "http://127.0.0.1:9", "m", attempts=2, pause=0.01).first()
    assert row.embedding is None and "Refused" in row.embedding_error


def test_extraction_through_http(spark, url):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "broken"), (3, "delta eps")], "paragraph_id long, text string")
    provider = S.HttpProvider(url, "m", attempts=2, pause=0.01)
    out = {r.paragraph_id: r for r in extract.extract(df, provider).collect()}
    assert out[1].evidence_valid and out[3].evidence_valid and out[2].raw is None
    asked = df.withColumn("predicted_labels", F.array(F.lit("property"))).withColumn("semantic_score", F.lit(0.25))
    asked = asked.withColumn("prompt", S.extraction_prompt(asked))
    assert asked.filter("paragraph_id = 1").first().prompt == 'paragraph_id: 1\nlabels: property\nsimilarity: 0.2500\ntext:\n"""alpha beta gamma"""'
    rows = {r.paragraph_id: r for r in S.generate(asked.union(asked.filter("paragraph_id = 1").withColumn("paragraph_id", F.lit(4).cast("long")).withColumn("prompt", F.lit(None).cast("string"))), provider).collect()}
    assert rows[1].output_tokens == 7 and rows[1].request_error is None and rows[2].raw is None and "500" in rows[2].request_error
    assert rows[4].raw is None and rows[4].request_error is None and rows[2].output_tokens is None
