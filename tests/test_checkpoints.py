"""Items of operations as state machines, across micro-batches, restarts and a kill."""

import os
import signal
import subprocess
import sys
import time
from datetime import datetime, timedelta

import pytest
from litspark.streaming import checkpoints as C

from .conftest import ROOT

DDL = "operation_id string, item_key string, event string, at timestamp, seq long, message string"
T0 = datetime(2024, 1, 1)


def event(op, item, kind, minute, seq=0, message=None):
    return (op, item, kind, T0 + timedelta(minutes=minute), seq, message)


STEPS = [
    [event("a", "1", "started", 0), event("a", "2", "started", 1), event("b", "1", "started", 1), event("c", "1", "error", 2, message="x"), event("d", "1", "started", 2)],
    [event("a", "1", "ok", 5), event("b", "1", "error", 6), event("c", "1", "error", 7, message="y"), event("c", "1", "error", 7, 1, "z"), (None, "1", "ok", T0, 0, None), ("a", None, "ok", T0, 0, None)],
    [event("a", "2", "ok", 9), event("a", "2", "error", 8), event("c", "1", "started", 3), event("e", "1", "started", 200)],
    [event("b", "1", "ok", 201), event("e", "2", "odd", 202)],
]


def write(spark, path, steps):
    for rows in steps:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def states(spark, target):
    return {(r.operation_id, r.item_key): (r.state, r.errors, r.oks) for r in C.item_states(spark.read.parquet(target)).collect()}


WANT = {("a", "1"): ("completed", 0, 1), ("a", "2"): ("completed", 1, 1), ("b", "1"): ("completed", 1, 1), ("c", "1"): ("failed", 3, 0), ("d", "1"): ("interrupted", 0, 0), ("e", "1"): ("active", 0, 0), ("e", "2"): ("active", 0, 0)}


def run(spark, base):
    events = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    C.track(spark, events, f"{base}/changes", f"{base}/checkpoint", late="10 minutes")


def test_states_in_steps(spark, tmp_path):
    """One call a step and one call for all give the same; timers mark what went silent."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for step in STEPS:
        write(spark, f"{a}/events", [step])
        run(spark, a)
    write(spark, f"{b}/events", STEPS)
    run(spark, b)
    assert states(spark, f"{a}/changes") == WANT == states(spark, f"{b}/changes")
    changes = spark.read.parquet(f"{a}/changes").filter("operation_id = 'b'").orderBy("version").collect()
    assert [r.state for r in changes] == ["active", "active", "interrupted", "completed"]  # silent for three hours, then done
    last = C.item_states(spark.read.parquet(f"{a}/changes"))
    assert last.filter("operation_id = 'c'").first().message == "z"
    planned = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "1"), ("d", "1"), ("e", "1"), ("e", "3"), ("f", "1"), ("f", "1")], "operation_id string, item_key string")
    ops = {r.operation_id: r for r in C.operation_states(planned, last).collect()}
    assert {k: r.state for k, r in ops.items()} == {"a": "completed", "c": "failed", "d": "interrupted", "e": "active", "f": "active"}
    assert (ops["e"].total, ops["e"].pending, ops["a"].errors, ops["f"].total) == (2, 1, 1, 1)
    assert sorted(map(tuple, C.to_do(planned, last).collect())) == [("d", "1"), ("e", "1"), ("e", "3"), ("f", "1")]


CHILD = """
import sys
from pyspark.sql import SparkSession
from litspark.streaming import checkpoints as C
from tests.test_checkpoints import run
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
run(spark, sys.argv[1])
"""


def test_killed_and_resumed(spark, tmp_path):
    """A query whose driver is killed after its first batch goes on from there; nothing is lost or counted twice."""
    base = str(tmp_path)
    write(spark, f"{base}/events", STEPS)
    child = subprocess.Popen([sys.executable, "-c", CHILD, base], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    commits, until = f"{base}/checkpoint/commits/0", time.time() + 120
    while not os.path.exists(commits) and time.time() < until and child.poll() is None:
        time.sleep(0.05)
    assert os.path.exists(commits)
    os.killpg(child.pid, signal.SIGKILL)  # the child's own session
    child.wait()
    run(spark, base)
    assert states(spark, f"{base}/changes") == WANT


def test_states_by_bucket(spark, tmp_path):
    """The state store holds a bucket a key, not an item a key; items of one bucket keep their own counts, last events and
    timers over several batches, in a session of another time zone too."""
    base, n = str(tmp_path), 300
    first = [event("o", str(i), ("started", "error", "ok")[i % 3], i % 50, seq=i) for i in range(n)]
    second = [event("o", str(i), "error", i % 50, seq=i) for i in range(0, n, 2)] + [event("o", "0", "error", 40, seq=9), event("new", "1", "started", 100)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    for rows in (first, second):
        write(spark, f"{base}/events", [rows])
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        events = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
        C.track(spark, events, f"{base}/changes", f"{base}/checkpoint", 2, "70 minutes", late="10 minutes", buckets=4)
        store = spark.read.format("statestore").option("stateVarName", "items").load(f"{base}/checkpoint")
        assert store.count() == 4
        got = C.item_states(spark.read.parquet(f"{base}/changes")).selectExpr("*", "unix_seconds(at) - %d secs" % int(datetime(2024, 1, 1).astimezone().timestamp())).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = {("new", "1"): ("active", 0, 0, 100, 1)}
    for i in range(n):
        both = [("started", "error", "ok")[i % 3]] + ["error"] * (i % 2 == 0) + ["error"] * (i == 0)
        at = 40 if i == 0 else i % 50  # of equal (at, seq) the later batch's event counts
        errors, oks = both.count("error"), both.count("ok")
        state = "completed" if both[-1] == "ok" else "failed" if both[-1] == "error" and errors >= 2 else "active" if at + 70 >= 90 else "interrupted"
        want["o", str(i)] = (state, errors, oks, at, 1 + (i % 2 == 0) + (state == "interrupted"))
    assert {(r.operation_id, r.item_key): (r.state, r.errors, r.oks, r.secs // 60, r.version) for r in got} == want


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
