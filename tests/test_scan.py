"""Running sums over one order."""

import numpy as np
from litspark.operators.scan import numbered, prefix_scan, running
from pyspark.sql import functions as F


def test_running_starts_anew():
    assert running(np.array([1, 2, 3, 4]), np.array([False, True, False, True]), 10).tolist() == [11, 2, 5, 4]
    assert running(np.array([1, 2]), np.array([False, False]), 5).tolist() == [6, 8]


def test_groups_and_ties_against_windows(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("g"), F.lit(0.5).alias("same"), F.when(F.col("id") % 11 != 0, F.col("id") % 5).alias("v"))
    got = {r.id: (r.s, r.n) for r in prefix_scan(df, [F.desc("same"), "id"], {"s": F.col("v"), "n": F.lit(1)}, by=["g"]).collect()}
    want, count = {}, {}
    for r in df.orderBy("id").collect():
        s, n = count.get(r.g, (0, 0))
        count[r.g] = want[r.id] = (s + (r.v or 0), n + 1)
    assert got == want


def test_equal_first_columns_spread_over_tasks(spark):
    """One score and ids of one prefix: the rows still lie in many partitions."""
    df = spark.range(4000).select(F.lit(1.0).alias("score"), F.format_string("prefix-%06d", "id").alias("key"))
    out = numbered(df, [F.desc("score"), "key"], "rank")
    assert [r["rank"] for r in out.orderBy("key").collect()] == list(range(1, 4001))
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan
    import re

    path = re.search(r"file:\S*?/scan-[0-9a-f]+", plan).group(0)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_empty_and_nulls(spark):
    assert numbered(spark.range(0).select("id"), ["id"], "n").collect() == []
    rows = numbered(spark.createDataFrame([(None,), (2,), (1,)], "k int"), ["k"], "n").collect()
    assert sorted((r.n, r.k) for r in rows) == [(1, None), (2, 1), (3, 2)]
