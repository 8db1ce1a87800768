"""Bootstrap intervals, curves and strata."""

import numpy as np
from litspark.functions.labels import CLASSES
from litspark.operators import corpus, sampling
from litspark.operators import evaluate as E
from pyspark.sql import functions as F

from .test_values import long_rows


def brute(y, p, ids, n, seed=42):
    w = E.poisson_weights(np.array(ids), n, seed)
    out = {}
    ratio = lambda a, b: a / b if b else None
    for r in range(n):
        c = w[:, r]
        if not c.sum():
            continue
        tp, fp, fn = ((c[:, None] * m).sum(0) for m in (y & p, (1 - y) & p, y & (1 - p)))
        f = [ratio(2 * a, 2 * a + b + d) for a, b, d in zip(tp, fp, fn)]
        values = {("macro_f1", "all"): np.mean([x or 0.0 for x in f]), ("micro_f1", "all"): ratio(2 * tp.sum(), 2 * tp.sum() + fp.sum() + fn.sum()) or 0.0}
        values |= {("exact_match", "all"): (c * (y == p).all(1)).sum() / c.sum(), ("hamming_loss", "all"): (fp + fn).sum() / (c.sum() * y.shape[1])}
        for k, name in enumerate(CLASSES):
            values |= {("precision", name): ratio(tp[k], tp[k] + fp[k]), ("recall", name): ratio(tp[k], tp[k] + fn[k]), ("f1", name): f[k]}
        for k, v in values.items():
            out.setdefault(k, []).extend([] if v is None else [v])
    bounds = lambda v: (round(float(np.percentile(v, 2.5)), 4), round(float(np.percentile(v, 97.5)), 4)) if len(v) >= 50 else (None, None)
    return {k: (len(v), *bounds(v)) for k, v in out.items()}


def test_bootstrap_against_brute_force(spark):
    """Class 4 is rare, so that few replicates define its precision; class 5 never occurs."""
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, (60, 5)), rng.integers(0, 2, (60, 5))
    y[:, 3:], p[:, 3:] = 0, 0
    y[0, 3] = 1
    got = {(r.metric, r["class"]): (r.valid, r.lower, r.upper) for r in E.bootstrap(long_rows(spark, y.tolist(), p.tolist(), (p * 1.0).tolist()), 80).collect()}
    want = brute(y, p, list(range(60)), 80)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1.01e-4) for a, b in zip(got[k][1:], want[k][1:])), (k, got[k], want[k])
    assert got[("precision", CLASSES[3])] == (0, None, None) and 0 < got[("recall", CLASSES[3])][0] < 80 and got[("f1", CLASSES[4])] == (0, None, None)


def test_bootstrap_limits_and_weights(spark):
    rows = long_rows(spark, [[1, 0, 1, 0, 1]] * 8, [[1, 0, 0, 0, 1]] * 8, [[0.5] * 5] * 8)
    assert E.bootstrap(rows.filter("id < 4"), 100).count() == 0 and E.bootstrap(rows, 9).count() == 0
    w = E.poisson_weights(np.arange(4000), 50, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05
    plan = E.bootstrap_counts(rows, 100, 42, CLASSES)._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "BroadcastExchange" not in plan


def test_curve_of_a_class_without_positives(spark):
    y = [[1, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
    rows = E.pr_curve(long_rows(spark, y, y, [[0.9, 0.3, 0.1, 0.1, 0.1], [0.2, 0.4, 0.1, 0.1, 0.1]])).collect()
    assert sorted((r.threshold, r.precision, r.recall) for r in rows if r["class"] == CLASSES[0]) == [(0.2, 0.5, 1.0), (0.9, 1.0, 1.0)]
    assert [(r.threshold, r.precision, r.recall) for r in rows if r["class"] == CLASSES[1]] == [(None, 0.0, 0.0)]


def test_strata_are_bounded_before_sorting(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 1000 / 1000.0).alias("score"))
    out = sampling.stratified_sample(df, 40, "score", "k")
    plan = out._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    rows = out.collect()
    edges = [sum(r.score >= e for e in sampling.STRATA) for r in rows]
    assert len(rows) == len({r.k for r in rows}) == 40 and min(edges.count(s) for s in (1, 2, 3, 4)) >= 10
    few = spark.range(5).select(F.col("id").alias("k"), F.lit(-1.0).alias("score"))
    assert sampling.stratified_sample(few, 3, "score", "k").count() == 3


def test_corpus_hash_tree(spark):
    sha = lambda n: spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"))
    h = lambda df, **k: corpus.corpus_hash(df, **k).first()
    a = h(sha(3000), slice_rows=8)
    assert a == h(sha(3000).orderBy(F.desc("text_sha256")), slice_rows=8) and a.n == 3000
    assert a.corpus_hash != h(sha(2999), slice_rows=8).corpus_hash
    assert h(sha(10).union(sha(1))).corpus_hash != h(sha(10)).corpus_hash
    assert h(sha(0)).n == 0
