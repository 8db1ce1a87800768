"""Scores and metrics that lie halfway between two rounded values, against their SQL."""

import math

import duckdb
from litspark.operators import evaluate as E
from litspark.plans import catalogue

from .oracle import compare

IDS = [i for i in range(1, 900) if i % 37]  # the rows that the queries keep
ANCHORS = (3, 57, 111, 222, 333)


def check(spark, path, scores, quality, *names):
    """The queries on vectors whose cosine with every anchor is the row's score, and on labels of the same rows."""
    flat = {i: 1.0 for i in ANCHORS} | {i: s for i, s in scores.items() if i not in ANCHORS}
    rows = [(i, [float(s), math.sqrt(1 - s * s)], 0) for i, s in flat.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(list(quality.items()), "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return [compare(catalogue.QUERIES[n](spark, str(path)), con, catalogue.ORACLE_SQL[n]) for n in names]


def test_scores_at_each_threshold(spark, tmp_path):
    """Cosines one millionth below, at and above each threshold of the grid; 0.039999 is the one that went wrong."""
    near = [round(2 * (20 + 2 * t) / 100 - 1 + d / 1e6, 6) for t in range(38) for d in (-2, -1, 0, 1)]
    assert 0.039999 in near
    scores = dict(zip([i for i in IDS if i not in ANCHORS], near))
    check(spark, tmp_path, scores, {i: i % 2 for i in scores}, "threshold_metrics_grid", "calibrate_threshold")


def test_metrics_halfway(spark, tmp_path):
    rows = IDS[:800]
    got, _ = check(spark, tmp_path, dict.fromkeys(rows, 1.0), {i: int(k < 57) for k, i in enumerate(rows)}, "threshold_metrics_grid", "calibrate_threshold")
    assert {r[0] for r in got} == {0.0712}  # accuracy, 57 of 800


def test_scaled_round_is_the_sql_round(spark):
    values = [(2 * k + 1) / 20000 for k in range(-2000, 10000)] + [0.0, -0.0, 1.0, 123456.78905]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(E.scaled_round("v", 4).alias("x")).collect()]
    assert got == [x for (x,) in duckdb.execute("select round(v, 4) from (select unnest(?::double[]) as v)", [values]).fetchall()]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(E.scaled_round("v", 4).alias("x")).collect()
    assert odd[0].x is None and math.isnan(odd[1].x) and odd[2].x == math.inf
