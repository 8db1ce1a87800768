"""The inverted-file index."""

import re

import numpy as np
import pytest
from litspark.operators import index, ivf
from litspark.plans import model_plans
from litspark.sources.shared import new_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def clustered(n=3000, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d)) * 4
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a third are one vector
    return x


def frame(spark, x, name="faiss_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def brute(x, ids, k, metric):
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    out = {}
    for i in ids:
        s = np.round(u @ u[i], 6) if metric == "cosine" else np.round(np.linalg.norm(x - x[i], axis=1), 6)
        top = np.lexsort((np.arange(len(x)), -s if metric == "cosine" else s))[:k]
        out[int(i)] = [(int(j), float(s[j])) for j in top]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("metric", ivf.METRICS)
def test_exact_and_approximate_search(spark, metric):
    x = clustered()
    path = new_path(spark, "ivf-test")
    manifest = ivf.build(frame(spark, x), path, metric=metric)
    assert manifest["n_vectors"] == len(x)
    idx = ivf.InvertedFile(spark, path, check=True)
    ids = np.arange(5, len(x), 150)
    queries = frame(spark, x, "query_id").filter(F.col("query_id").isin(ids.tolist()))
    want = brute(x, ids, 10, metric)
    got = found(idx.search(queries, 10, 2, exact=True))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q]))
    probes, measured = idx.tune(frame(spark, x, "query_id").filter("query_id % 150 = 40"), 10, 0.95)
    approx = idx.search(queries, 10, probes)
    exact = spark.createDataFrame([(q, i) for q, v in want.items() for i, _ in v], "query_id long, id long")
    assert measured >= 0.95 and ivf.recall(approx, exact) >= 0.9 and probes < len(idx.cells) / 2


def test_only_probed_cells_are_read(spark):
    path = new_path(spark, "ivf-test")
    ivf.build(frame(spark, clustered()), path)
    idx = ivf.InvertedFile(spark, path)
    out = idx.search(frame(spark, clustered(), "query_id").filter("query_id = 2500"), 5, 3)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    cells = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([\d,]+)\)", plan)
    assert cells and len(cells.group(1).split(",")) == 3
    files = idx.rows.filter(F.col("cell").isin([int(c) for c in cells.group(1).split(",")])).count()
    assert files < idx.rows.count()


def test_filters_never_shorten_a_result(spark):
    x = clustered()
    rows = frame(spark, x).withColumn("class_1", F.col("faiss_id") % 500 == 7).withColumn("class_2", F.lit(True))
    path = new_path(spark, "ivf-test")
    ivf.build(rows, path)
    idx = ivf.InvertedFile(spark, path)
    one = frame(spark, x, "query_id").filter("query_id = 10")
    got = idx.search(one, 6, 1, classes=[1, "class_2", "9"])
    assert sorted(r.id for r in got.collect()) == list(range(7, 3000, 500))
    assert found(idx.search(one, 9, 1, exact=True, max_score=0.5))[10][0][1] <= 0.5
    assert len(found(idx.search(one, 9, 1, min_score=2.0))) == 0


def test_odd_vectors_and_errors(spark):
    x = clustered(60, 4)
    odd = spark.createDataFrame([(100, None), (101, [float("nan")] * 4), (102, [1.0]), (103, [0.0] * 4), (104, [1.0, None, 0.0, 0.0])], "faiss_id long, embedding array<double>")
    path = new_path(spark, "ivf-test")
    assert ivf.build(frame(spark, x).union(odd), path, cells=5)["n_vectors"] == 61
    idx = ivf.InvertedFile(spark, path)
    rows = found(idx.search(frame(spark, x, "query_id").filter("query_id < 3").union(odd.withColumnRenamed("faiss_id", "query_id")), 100, exact=True))
    assert set(rows) == {0, 1, 2, 103} and all(len(v) == 61 for v in rows.values()) and dict(rows[0])[103] == 0
    with pytest.raises(ValueError):
        ivf.build(frame(spark, x), path, metric="dot")
    with pytest.raises(ValueError):
        ivf.build(frame(spark, x).limit(0), path)
    plain = new_path(spark, "plain-test")
    index.save(frame(spark, x), plain, {"model": "m"})
    with pytest.raises(ValueError):
        ivf.InvertedFile(spark, plain)


def test_many_queries_go_in_blocks(spark, monkeypatch):
    x = clustered(300, 8)
    path = new_path(spark, "ivf-test")
    ivf.build(frame(spark, x), path)
    monkeypatch.setattr(ivf, "MAX_QUERIES", 20)
    got = found(ivf.InvertedFile(spark, path).search(frame(spark, x, "query_id").filter("query_id % 5 = 0"), 3, 4, exact=True))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in brute(x, range(0, 300, 5), 3, "cosine").items()}


def test_registered_search_has_the_recall(spark):
    got = model_plans.ivf_search(spark, SF)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in e], float), [r.vec_id for r in e]
    want = brute(x, [i for i, v in enumerate(ids) if v % 50 == 0], 10, "cosine")
    exact = spark.createDataFrame([(ids[q], ids[i]) for q, v in want.items() for i, _ in v], "query_id long, id long")
    assert ivf.recall(got.withColumnRenamed("vec_id", "id"), exact) >= 0.9
