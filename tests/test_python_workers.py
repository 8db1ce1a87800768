"""What a Python worker holds of a task: one product a row, few texts at a time."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from litspark.functions import text as T
from litspark.functions import vectors as V
from litspark.plans import model_plans
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_one_product_for_all_filters(spark):
    """Filters on labels and states, which follow from the product, don't bring a second one into the task."""
    df = model_plans.classified(spark, SF).filter("status = 'MODEL_RELEVANT' and size(predicted_labels) > 0")
    assert df._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert df.count()


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_cosines(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(1)
    x, anchors = rng.normal(size=(50, 3)), rng.normal(size=(2, 3))
    x[4] = 0
    rows = [(i, None if i % 7 == 3 else [float(a) for a in v]) for i, v in enumerate(x)]
    rows[9] = (9, [None, 1.0, float("nan")])
    want = {i: None if v is None else V.unit(np.nan_to_num(np.array(v, dtype=float))) @ V.unit(anchors).T for i, v in rows}
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(2)
    got = {r.i: r.c for r in df.select("i", V.similarities(F.col("v"), anchors).alias("c")).collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (w is None) and (w is None or np.allclose(got[i], w, atol=1e-12)) for i, w in want.items())
    assert V.cosines(pa.array([None, None], pa.list_(pa.float32())), V.unit(anchors)).to_pylist() == [None, None]
    with pytest.raises(ValueError):
        V.cosines(pa.array([[1.0, 0.0, 0.0], [1.0]]), V.unit(anchors))


def test_few_texts_at_a_time(spark):
    texts = [None if i % 5 == 0 else "" if i % 5 == 1 else "café Å" * i if i % 5 == 2 else "plain" * i for i in range(300)]
    want = [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    parts = list(T.nfc.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(map(len, parts)) <= T.NFC_ROWS and [t for p in parts for t in p.to_pylist()] == want
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    assert [r.n for r in df.select("i", T.nfc("t").alias("n")).orderBy("i").collect()] == want
