"""Encoders and language models behind HTTP, asked from tasks: batches, one connection a task, retries, single requests.

The service speaks the public JSON interface of local model servers: ``/api/tags`` lists models, ``/api/embed`` encodes a
batch, ``/api/embeddings`` one text, ``/api/generate`` answers a prompt.  A request is repeated with growing pauses after a
broken connection, a time-out, 429 or 5xx (Retry-After is obeyed); what still fails is a row's own error, not the job's.
"""

from __future__ import annotations

import http.client
import json
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIED = (429, 500, 502, 503, 504)
DIMENSION = 768  # of a service that can't be asked
#: Fields of an answer that are kept as its metrics.
METRICS = {"prompt_eval_count": "prompt_tokens", "eval_count": "output_tokens", "prompt_eval_duration": "prompt_eval_duration", "eval_duration": "eval_duration", "total_duration": "total_duration"}
SYSTEM_PROMPT = (
    "Extract structured information from one paragraph of a scientific article. Use only what the paragraph says; add, guess and generalise nothing. Answer with one JSON object whose fields concepts, "
    "definitions, determinants, dimensions, causal_relations, properties, mechanisms, consequences and evidence are arrays of strings; evidence quotes the paragraph literally. Absent fields are empty arrays."
)


class ServiceError(RuntimeError):
    """A request that failed for good."""


class Connection:
    """One kept connection to a service; not for sharing between threads."""

    def __init__(self, url: str, timeout: float = 60.0, attempts: int = 4, pause: float = 0.5, longest: float = 30.0):
        self.base, self.timeout, self.attempts, self.pause, self.longest = urlsplit(url.rstrip("/")), timeout, attempts, pause, longest
        self._http = None

    def _send(self, method: str, path: str, body: bytes | None):
        if self._http is None:
            kind = http.client.HTTPSConnection if self.base.scheme == "https" else http.client.HTTPConnection
            self._http = kind(self.base.hostname, self.base.port, timeout=self.timeout)
        self._http.request(method, self.base.path + path, body, {"Content-Type": "application/json"} if body else {})
        r = self._http.getresponse()
        return r.status, r.headers.get("Retry-After"), r.read()

    def call(self, method: str, path: str, payload: dict | None = None) -> dict:
        body, why = json.dumps(payload).encode() if payload is not None else None, ""
        for attempt in range(self.attempts):
            wait = min(self.longest, self.pause * 2**attempt)
            try:
                status, after, content = self._send(method, path, body)
                if status == 200:
                    return json.loads(content)
                why = f"HTTP {status}"
                if status not in RETRIED:
                    break
                if after and after.isdigit():
                    wait = min(self.longest, float(after))
            except ValueError as e:  # not JSON
                why = f"{type(e).__name__}: {e}"
                break
            except (OSError, http.client.HTTPException) as e:
                why = f"{type(e).__name__}: {e}"
                self.close()
            if attempt + 1 < self.attempts:
                time.sleep(wait)
        raise ServiceError(f"{method} {path}: {why}")

    def close(self) -> None:
        if self._http is not None:
            self._http.close()
            self._http = None


# ---------------------------------------------------------------- what a driver asks
def list_models(url: str, timeout: float = 5.0) -> list[str]:
    """Names of installed models; none where the service can't be reached."""
    try:
        return [m["name"] for m in Connection(url, timeout, attempts=1).call("GET", "/api/tags").get("models", []) if m.get("name")]
    except ServiceError:
        return []


def check_connection(url: str, timeout: float = 5.0) -> bool:
    try:
        Connection(url, timeout, attempts=1).call("GET", "/api/tags")
        return True
    except ServiceError:
        return False


def is_installed(url: str, model: str) -> bool:
    """Whether an installed model's name contains this one, in any case."""
    return any(model.lower().strip() in m.lower() for m in list_models(url))


def dimension(url: str, model: str, timeout: float = 60.0) -> int:
    """Length of the model's vectors, from one request."""
    try:
        return len(Connection(url, timeout, attempts=1).call("POST", "/api/embed", {"model": model, "input": ["test"]})["embeddings"][0])
    except (ServiceError, KeyError, IndexError, TypeError):
        return DIMENSION


# ---------------------------------------------------------------- encoding
def _vectors(connection: Connection, model: str, texts: list[str]) -> list[tuple[list | None, str | None]]:
    """A vector or an error for each text: one request for all of them, one for each where that fails."""
    good = lambda v: isinstance(v, list) and len(v) > 0
    try:
        found = connection.call("POST", "/api/embed", {"model": model, "input": texts}).get("embeddings", [])
        if len(found) == len(texts) and all(map(good, found)):
            return [(v, None) for v in found]
    except ServiceError:
        pass
    out = []
    for text in texts:
        try:
            v = connection.call("POST", "/api/embeddings", {"model": model, "prompt": text}).get("embedding")
            out.append((v, None) if good(v) else (None, "the answer has no vector"))
        except ServiceError as e:
            out.append((None, str(e)))
    return out


def encode(df: DataFrame, url: str, model: str, text: str = "text", batch: int = 32, normalize: bool = True, timeout: float = 120.0, attempts: int = 4, pause: float = 0.5) -> DataFrame:
    """df with embedding (array<float>) and embedding_error.

    Vectors have length 1 unless normalize is off; a zero vector stays zero.  A null text isn't asked for and has neither
    vector nor error; an empty one is asked for as it is.  Equal texts of a batch are asked for once.  An empty table
    gives an empty one."""

    @F.pandas_udf("vector array<float>, error string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        connection = Connection(url, timeout, attempts, pause)
        try:
            for part in parts:
                known: dict[str, tuple] = {}
                todo = list(dict.fromkeys(t for t in part if t is not None))
                for i in range(0, len(todo), batch):
                    some = todo[i : i + batch]
                    known.update(zip(some, _vectors(connection, model, some)))
                rows = []
                for t in part:
                    v, error = known.get(t, (None, None))
                    if v is not None:
                        v = np.asarray(v, dtype=np.float64)
                        norm = np.linalg.norm(v) if normalize else 1.0
                        v = (v / (norm if norm else 1.0)).astype(np.float32)
                    rows.append((v, error))
                yield pd.DataFrame({"vector": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})
        finally:
            connection.close()

    return df.withColumn("_asked", ask(F.col(text))).select(*df.columns, F.col("_asked.vector").alias("embedding"), F.col("_asked.error").alias("embedding_error"))


# ---------------------------------------------------------------- generating
def extraction_prompt(df: DataFrame) -> Column:
    """What a paragraph is asked with: ids, labels, probabilities (a map, by class), score, text; absent ones are N/A."""
    has = lambda c: c in df.columns
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("N/A")), F.lit("\n"))
    parts = [line(c, F.col(c).cast("string")) for c in ("paragraph_id", "article_id") if has(c)]
    if has("predicted_labels"):
        parts.append(line("labels", F.when(F.size("predicted_labels") > 0, F.array_join("predicted_labels", ", "))))
    if has("predicted_probabilities"):
        pairs = F.transform(F.array_sort(F.map_entries("predicted_probabilities")), lambda e: F.concat(e.key, F.lit(": "), F.format_string("%.2f", e.value)))
        parts.append(line("probabilities", F.when(F.size(pairs) > 0, F.array_join(pairs, ", "))))
    if has("semantic_score"):
        parts.append(line("similarity", F.format_string("%.4f", F.coalesce(F.col("semantic_score").cast("double"), F.lit(0.0)))))
    return F.concat(*parts, F.lit('text:\n"""'), F.coalesce(F.col("text"), F.lit("")), F.lit('"""'))


class HttpProvider:
    """A provider for extraction: called with a prompt it returns the raw answer; one connection a worker process."""

    def __init__(self, url: str, model: str, system: str = SYSTEM_PROMPT, options: dict | None = None, keep_alive: str = "5m", timeout: float = 60.0, attempts: int = 4, pause: float = 0.5):
        self.url, self.model, self.system, self.keep_alive = url, model, system, keep_alive
        self.options = {"temperature": 0.0, "seed": 42} | (options or {})
        self.how = (timeout, attempts, pause)
        self._connection = None

    def __getstate__(self):
        return self.__dict__ | {"_connection": None}

    def ask(self, prompt: str) -> tuple[str, dict]:
        if self._connection is None:
            self._connection = Connection(self.url, *self.how)
        payload = {"model": self.model, "system": self.system, "prompt": prompt, "stream": False, "format": "json", "keep_alive": self.keep_alive, "options": self.options}
        answer = self._connection.call("POST", "/api/generate", payload)
        return answer.get("response", "{}"), {name: int(answer.get(field) or 0) for field, name in METRICS.items()}

    def __call__(self, prompt: str) -> str:
        return self.ask(prompt)[0]


def generate(df: DataFrame, provider: HttpProvider, prompt: str = "prompt") -> DataFrame:
    """df with raw, the metrics of the answer (null where it failed) and request_error.  A null prompt isn't asked for."""
    ddl = "raw string, " + ", ".join(f"{m} long" for m in METRICS.values()) + ", error string"

    @F.pandas_udf(ddl)
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part:
                try:
                    raw, metrics = provider.ask(p) if p is not None else (None, {})
                    rows.append({"raw": raw, **metrics, "error": None})
                except ServiceError as e:
                    rows.append({"raw": None, "error": str(e)})
            out = pd.DataFrame(rows, columns=["raw", *METRICS.values(), "error"])
            yield out.astype({m: "Int64" for m in METRICS.values()}).astype({"raw": object, "error": object}).where(lambda x: x.notna(), None)

    asked = df.withColumn("_asked", ask(F.col(prompt)))
    return asked.select(*df.columns, "_asked.raw", *(f"_asked.{m}" for m in METRICS.values()), F.col("_asked.error").alias("request_error"))
