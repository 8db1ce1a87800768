import math

import numpy as np
import pandas as pd
import pytest
from litspark.llm import srs_search as srs
from pyspark.sql import functions as F


def test_chi_square():
    assert abs(srs.chi_square_cdf(15.507, 8) - 0.95) < 1e-4  # table values
    assert abs(srs.chi_square_quantile(0.99, 4) - 13.277) < 1e-3


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def held(got, want):
    """Share of the exact neighbours that were found, with exact scores."""
    true = {(r.query_id, r.vec_id): r.score for r in want}
    hits = [true[r.query_id, r.vec_id] - r.score for r in got if (r.query_id, r.vec_id) in true]
    assert len(got) == len(want) and max(map(abs, hits)) < 1e-9
    return len(hits) / len(want)


@pytest.mark.parametrize("cell_rows", [srs.CELL_ROWS, 300])
def test_recall_and_scores(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(srs, "CELL_ROWS", cell_rows)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert held(srs.nearest(df).collect(), srs.exact(df).collect()) >= 0.9


def clusters(n, d=32, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 50, d))[np.arange(n) % (n // 50)] * 3 + rng.normal(size=(n, d)) * 0.3


def test_clustered_rows_are_not_all_verified(spark):
    """At shipped settings: recall, and what was verified of the rows in the cells that queries visited."""
    x = clusters(40_000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    few = F.col("vec_id") % 1000 == 7
    got, want = srs.nearest(df, few).collect(), srs.exact(df, few).collect()
    assert held(got, want) >= 0.9
    rows = srs.usable(df)
    shared = spark.sparkContext.broadcast(srs.fit(rows))
    placed = srs._placed(rows, shared, 0)
    assert placed.count() == len(x)  # rows lie in one cell each
    own = srs._searched(placed, srs._placed(rows.filter(few), shared, 1), srs.K).groupBy("query_id").agg(F.max("verified").alias("n"), F.max("score").alias("worst"))
    assert own.agg(F.avg("n")).first()[0] < 0.5 * len(x) / shared.value[32][0].cells
    asking = rows.filter(few).join(own, rows.vec_id == own.query_id).withColumn("bound2", F.col("worst") * F.col("worst"))
    tree = shared.value[32][0]
    visits = srs._placed(asking, shared, 1, other=True).groupBy("id").count().agg(F.avg("count")).first()[0] or 0
    assert tree.cells >= 3 and visits < tree.cells - 1


def test_walk_gives_projected_neighbours_in_order():
    rng = np.random.default_rng(1)
    points = np.concatenate((rng.normal(size=(3000, srs.M)), np.zeros((200, srs.M))))
    q = rng.normal(size=srs.M)
    got = list(srs.KdTree(points).neighbours(q))
    at, d = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    assert sorted(at.tolist()) == list(range(3200)) and (np.diff(d) >= 0).all()
    np.testing.assert_allclose(d, ((points[at] - q) ** 2).sum(1))


def test_cells_and_reach():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(5000, srs.M))
    tree = srs.Cells(points[:1000], 16)
    cell = tree.locate(points)
    assert tree.cells == 16 and np.bincount(cell).min() > 100
    for q in points[:20]:
        near = ((points - q) ** 2).sum(1) <= 9.0
        assert set(cell[near].tolist()) <= set(tree.reach(q, 9.0))
    assert srs.Cells(np.ones((50, srs.M)), 8).cells == 1 and len(tree.reach(points[0], math.inf)) == 16


def test_slices_and_repeated_ids(spark, monkeypatch):
    """A cell of many rows is dealt over slices; of rows with one id the least vector counts."""
    monkeypatch.setattr(srs, "CELL_ROWS", 40)
    monkeypatch.setattr(srs, "SAMPLE", 64)
    x = clusters(600, 8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5, [-1e6] * 8, 0), (6, [1e6] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    tree, slices = srs.fit(srs.usable(df))[8]
    assert slices > 1
    assert held(srs.nearest(df).collect(), srs.exact(df).collect()) >= 0.9
    kept = {r.vec_id: r.v for r in srs.usable(df).filter("vec_id in (5, 6)").collect()}
    assert kept[5][0] == -1e6 and kept[6][0] < 1e5


def test_clashing_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    more = df.selectExpr("*", "1 as dim", "2 as cell", "3 as v", "4 as query_id", "5 as bound2", "6 as rank")
    assert sorted(map(tuple, srs.nearest(more).collect())) == sorted(map(tuple, srs.nearest(df).collect()))


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(30, 0, -1)] + [(0, same, 0), (100, same, 0)]
    rows += [(200, None, 0), (300, [0.0] * 3, 0), (400, [1.0, None, 2.0], 0), (500, [math.nan, 1.0, 1.0], 0), (600, [math.inf, 1.0, 1.0], 0)]
    rows += [(700, [1.0, 2.0], 0), (None, same, 0), (0, same, 0)] + [(1000 + i, rng.normal(size=3).tolist(), 0) for i in range(50)]
    got = srs.nearest(frame(spark, rows)).collect()
    assert {r.query_id for r in got} == {0, 100, 1000}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == list(range(1, 11))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == list(range(10))
    assert srs.nearest(frame(spark, [])).count() == 0
    few = srs.nearest(frame(spark, [(0, same, 0), (5, [2.0, 2.0, 3.0], 0)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 5, 1.0)]
