"""Tracked runs: figures, progress, cancelling and steps."""

import os
import time

import pytest
from litspark.operators import progress as P
from pyspark.sql import functions as F


def slow(spark, n, seconds):
    """n rows in eight tasks, each row taking a while."""

    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, n, 1, 8).mapInPandas(wait, "id long")


def left(tmp_path):
    return sorted(p for p in os.listdir(tmp_path) if not p.startswith("."))


def test_observed_rows_agree(spark, tmp_path):
    path = str(tmp_path / "out")
    run = P.start_write(spark.range(1000).withColumn("selected", F.col("id") % 4 == 0), path, F.col("selected"))
    figures = run.wait(60)
    assert (figures["state"], figures["rows"], figures["kept"], figures["discarded"]) == ("completed", 1000, 250, 750)
    assert figures["rows"] == spark.read.parquet(path).count() and figures["rows_per_second"] > 0
    p = run.progress()
    assert p["share"] == 1.0 and p["tasks_done"] == p["tasks"] > 0
    with pytest.raises(FileExistsError):
        P.start_write(spark.range(1), path)


def test_cancelled_leaves_nothing_and_others_go_on(spark, tmp_path):
    other = P.start_write(slow(spark, 800, 2), str(tmp_path / "other"))
    run = P.start_write(slow(spark, 800, 60), str(tmp_path / "out"))
    time.sleep(1)
    assert run.progress()["state"] == "running"
    began = time.time()
    run.cancel()
    assert run.wait()["state"] == "cancelled" and run.wait()["rows"] is None and time.time() - began < 30
    assert other.wait(60)["rows"] == 800
    assert left(tmp_path) == ["other"]


def test_failures_are_raised_and_leave_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        P.start_write(bad, str(tmp_path / "out")).wait()
    assert left(tmp_path) == []


def test_steps_go_on_where_they_stopped(spark, tmp_path):
    df, path, told = spark.range(500), str(tmp_path / "steps"), []
    assert P.write_in_steps(df, "id", path, 5, lambda i, n, f: told.append((i, n, f["rows"])) or i < 1) is None
    assert [t[:2] for t in told] == [(0, 5), (1, 5)]
    out = P.write_in_steps(df, "id", path, 5, lambda i, n, f: told.append((i, n, f["rows"])))
    assert [t[0] for t in told] == [0, 1, 2, 3, 4] and sum(t[2] for t in told) == 500
    assert sorted(r.id for r in out.collect()) == list(range(500))


def test_measure(spark):
    m = P.measure(spark.range(100))
    assert m["rows"] == 100 and m["seconds"] > 0


def test_models_are_measured(spark):
    from litspark.operators import evaluate

    gold = spark.createDataFrame([("a", 1), ("b", 0)], "paragraph_id string, human_label int")
    res = spark.createDataFrame([("a", 0.9, 1), ("b", 0.2, 2), ("c", 0.1, 3)], "paragraph_id string, aggregate_score double, rank int")
    rows = {r.model: r for r in evaluate.benchmark_models({"x": res, "y": res.filter("rank < 3")}, gold).collect()}
    assert (rows["x"].rows, rows["y"].rows) == (3, 2) and rows["x"].ndcg == 1.0 and rows["x"].rows_per_second > 0
