"""Calibration, ranking metrics, multilabel metrics, curves, bootstrap and checks.

Long form of multilabel data: (id, class, y, pred, prob), one row per item and class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from .scan import numbered, prefix_scan

R4 = lambda c: F.round(c, 4)


def scaled_round(c: Column | str, places: int) -> Column:
    """c rounded half up after scaling, as the SQL's round does it: F.round rounds the shortest decimal of a double instead, and
    (1 + 0.039999) / 2 then reaches 0.52, which the SQL leaves at 0.519999."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**places) / 10.0**places


def _ratio(a, b) -> Column:
    return F.try_divide(a.cast("double") if isinstance(a, Column) else F.col(a).cast("double"), b if isinstance(b, Column) else F.col(b))


def join_gold(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results with the last gold row of their paragraph."""
    last = gold.groupBy("paragraph_id").agg(F.max_by("human_label", "seq").alias("human_label")) if "seq" in gold.columns else gold.dropDuplicates(["paragraph_id"])
    return results.join(last.select("paragraph_id", "human_label"), "paragraph_id")


def grid(spark, first: int, step: int, n: int) -> DataFrame:
    """Thresholds (first + step * i) / 100 from integers, free of summed rounding."""
    return spark.range(n).select(((F.col("id") * step + first) / 100.0).alias("threshold"))


def _counts(rows: DataFrame, score: str, label: str, first: int, step: int, n: int, keys: list[str] = ()) -> DataFrame:
    """TP and FP at every grid threshold: each row falls into the last threshold it reaches; running sums from the top
    give the counts, so rows are read once and never multiplied by the grid."""
    i = F.floor((F.col(score) * 100.0 - first) / step + 1e-7)
    cell = F.least(F.greatest(i, F.lit(-1)), F.lit(n - 1)).cast("int")
    hist = rows.groupBy(*keys, cell.alias("i")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("m"))
    base = rows.sparkSession.range(-1, n).select(F.col("id").cast("int").alias("i"))
    if keys:
        base = base.crossJoin(F.broadcast(rows.select(*keys).distinct()))  # grid x classes
    full = base.join(hist, [*keys, "i"], "left").na.fill(0, ["p", "m"])
    down = Window.partitionBy(*keys).orderBy(F.desc("i"))
    whole = Window.partitionBy(*keys)
    full = full.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("m").over(down))
    full = full.withColumn("fn", F.sum("p").over(whole) - F.col("tp")).withColumn("tn", F.sum("m").over(whole) - F.col("fp"))
    return full.filter("i >= 0").withColumn("threshold", (F.col("i") * step + first) / 100.0).drop("p", "m")


def _prf(df: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    df = df.withColumn("precision", z(_ratio("tp", F.col("tp") + F.col("fp")))).withColumn("recall", z(_ratio("tp", F.col("tp") + F.col("fn"))))
    return df.withColumn("f1", z(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def threshold_grid(results: DataFrame, gold: DataFrame, first: int = 20, step: int = 2, n: int = 38) -> DataFrame:
    """Metrics of every threshold 0.20 .. 0.94 over annotated results; retrieved counts all results."""
    m = _prf(_counts(join_gold(results, gold), "aggregate_score", "human_label", first, step, n))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    r4 = lambda c: scaled_round(c, 4)
    every = _counts(results.withColumn("_one", F.lit(1)), "aggregate_score", "_one", first, step, n).select("i", F.col("tp").alias("retrieved"))
    m = m.join(every, "i")
    return m.select(
        "threshold", "tp", "fp", "fn", "tn", r4("precision").alias("precision"), r4("recall").alias("recall"), r4("f1").alias("f1"),
        r4(z(_ratio("tn", F.col("tn") + F.col("fp")))).alias("specificity"), r4(z(_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))).alias("accuracy"), "retrieved",
    )


def calibrate(results: DataFrame, gold: DataFrame, minimum_recall: float = 0.90) -> DataFrame:
    """The threshold of greatest F1 among those with enough recall, else of greatest recall; of equals the lowest.
    Without annotated results 0.50."""
    m = threshold_grid(results, gold)
    order = F.struct((F.col("recall") >= minimum_recall).cast("int"), F.when(F.col("recall") >= minimum_recall, F.col("f1")).otherwise(F.col("recall")), -F.col("threshold"))
    best = m.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), order).alias("b"), F.max(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n"))
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    pick = lambda c, d: F.when(has, F.col(f"b.{c}")).otherwise(F.lit(d)).alias(c)
    return best.select(pick("threshold", 0.5), pick("precision", 0.0), pick("recall", 0.0), pick("f1", 0.0), has.alias("calibrated"))


def ranking_metrics(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """P@k, R@k, MRR, MAP and nDCG@k over the annotated results in rank order."""
    rows = join_gold(results, gold)
    n_rel = gold.groupBy("paragraph_id").agg(F.max("human_label").alias("l")).agg(F.sum("l").alias("all_rel"))
    rows = prefix_scan(rows.select("paragraph_id", "rank", "human_label"), ["rank", "paragraph_id"], {"pos": F.lit(1), "hits": F.col("human_label")})
    rows = numbered(rows, [F.desc("human_label"), "rank", "paragraph_id"], "ideal")
    rel = F.col("human_label") == 1
    gain = lambda p: (F.pow(F.lit(2.0), F.col("human_label")) - 1) / F.log2(F.col(p) + 1.0)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = rows.agg(
        F.count_if(rel & (F.col("pos") <= k)).alias("tp"), F.least(F.count("*"), F.lit(k)).alias("top"), F.min(F.when(rel, F.col("pos"))).alias("first"),
        F.sum(F.when(rel, F.col("hits") / F.col("pos"))).alias("ap"), F.sum(F.when(F.col("pos") <= k, gain("pos"))).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain("ideal"))).alias("idcg"),
    )
    a = a.crossJoin(n_rel)  # one row each
    return a.select(
        R4(z(_ratio("tp", "top"))).alias("precision_at_k"), R4(z(_ratio("tp", "all_rel"))).alias("recall_at_k"), R4(z(F.try_divide(F.lit(1.0), F.col("first")))).alias("mrr"),
        R4(z(F.try_divide(F.col("ap"), F.col("all_rel")))).alias("map"), R4(z(F.try_divide(F.col("dcg"), F.col("idcg")))).alias("ndcg"),
    )


def class_thresholds(long: DataFrame) -> DataFrame:
    """Per class the threshold 0.10 .. 0.90 of greatest F1, the lowest of equals; without positives 0.5."""
    m = _prf(_counts(long, "prob", "y", 10, 2, 41, ["class"]))
    best = m.groupBy("class").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f1"), F.max(F.col("tp") + F.col("fn")).alias("pos"))
    return best.select("class", R4(F.when(F.col("pos") > 0, F.col("t")).otherwise(0.5)).alias("threshold"), R4(F.when(F.col("pos") > 0, F.col("f1")).otherwise(0.0)).alias("f1"))


def confusion(long: DataFrame) -> DataFrame:
    hit = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    return long.groupBy("class").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))


def class_metrics(long: DataFrame) -> DataFrame:
    """Per class: undefined precision (nothing predicted), recall and F1 (no positives), specificity (no negatives) are
    null; F1 is otherwise 0 where undefined."""
    c = confusion(long)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n, pos, neg = tp + fp + fn + tn, tp + fn, fp + tn
    p, r, s = _ratio("tp", tp + fp), _ratio("tp", pos), _ratio("tn", neg)
    f1 = F.when(pos > 0, F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    return c.select(
        "class", "tp", "fp", "fn", "tn", pos.alias("support"), R4(_ratio(pos, n)).alias("prevalence"), R4(p).alias("precision"), R4(r).alias("recall"), R4(s).alias("specificity"),
        R4(f1).alias("f1"), R4(_ratio(tp + tn, n)).alias("binary_accuracy"), R4((r + s) / 2).alias("balanced_accuracy"), R4(_ratio("fp", neg)).alias("fpr"), R4(_ratio("fn", pos)).alias("fnr"),
        ((pos > 0) & (neg > 0)).alias("is_valid"),
    )


def derive_class_zero(long: DataFrame) -> DataFrame:
    """Rows of class not_relevant: on where no active class is."""
    per = long.groupBy("id").agg((1 - F.max("y")).alias("y"), (1 - F.max("pred")).alias("pred"))
    return per.select("id", F.lit("not_relevant").alias("class"), "y", "pred")


def class_zero_metrics(long: DataFrame) -> DataFrame:
    """Class 0's metrics; without positives specificity is 1 and the false positive rate 0, whatever was predicted."""
    m = class_metrics(derive_class_zero(long))
    none = F.col("support") == 0
    return m.withColumn("specificity", F.when(none, 1.0).otherwise(F.col("specificity"))).withColumn("fpr", F.when(none, 0.0).otherwise(F.col("fpr")))


def global_metrics(long: DataFrame) -> DataFrame:
    """Macro, micro and weighted F1, macro and micro precision and recall, Hamming loss, subset accuracy, cardinality and
    density: one row."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    c = confusion(long).withColumn("p", z(F.try_divide(tp, tp + fp))).withColumn("r", z(F.try_divide(tp, tp + fn))).withColumn("f", z(F.try_divide(2 * tp, 2 * tp + fp + fn))).withColumn("s", tp + fn)
    S = lambda x: F.sum(x).cast("double")
    micro_p, micro_r = F.try_divide(S("tp"), S("tp") + S("fp")), F.try_divide(S("tp"), S("tp") + S("fn"))
    a = c.agg(
        R4(F.avg("f")).alias("macro_f1"), R4(z(F.try_divide(2 * S("tp"), 2 * S("tp") + S("fp") + S("fn")))).alias("micro_f1"), R4(z(F.try_divide(F.sum(F.col("f") * F.col("s")), F.sum("s")))).alias("weighted_f1"),
        R4(F.avg("p")).alias("macro_precision"), R4(F.avg("r")).alias("macro_recall"), R4(z(micro_p)).alias("micro_precision"), R4(z(micro_r)).alias("micro_recall"),
        R4(F.try_divide(S("fp") + S("fn"), S("tp") + S("fp") + S("fn") + S("tn"))).alias("hamming_loss"),
    )
    per = long.groupBy("id").agg((F.max(F.abs(F.col("y") - F.col("pred"))) == 0).cast("double").alias("same"), F.sum("y").alias("n"), F.count("*").alias("k"))
    b = per.agg(R4(F.avg("same")).alias("subset_accuracy"), R4(F.avg("n")).alias("cardinality"), R4(F.avg(F.col("n") / F.col("k"))).alias("density"))
    return a.crossJoin(b)  # one row each


def _by_score(long: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score of a class, with running sums from the top: a scan, as a class may
    have any number of scores."""
    d = long.groupBy("class", "prob").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("m"))
    d = prefix_scan(d, [F.desc("prob")], {"tp": F.col("p"), "fp": F.col("m")}, by=["class"])
    return d.join(d.groupBy("class").agg(F.max("tp").alias("pos"), F.max("fp").alias("neg")), "class")


def average_precision(long: DataFrame) -> DataFrame:
    """Step-wise sum of precision over recall steps; null without positives."""
    d = _by_score(long)
    return d.groupBy("class").agg(R4(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("pos"))).alias("average_precision"))


def roc_auc(long: DataFrame) -> DataFrame:
    """Rank statistic, ties one half; null unless both kinds occur."""
    d = _by_score(long)
    wins = F.sum(F.col("m") * (F.col("tp") - F.col("p") / 2.0))
    return d.groupBy("class").agg(R4(F.try_divide(wins, (F.max("pos") * F.max("neg")).cast("double"))).alias("roc_auc"))


def pr_curve(long: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score; a class without positives has the one point (0, 0)."""
    d = _by_score(long)
    point = lambda c: R4(F.when(F.col("pos") > 0, c).otherwise(0.0))
    tops = long.groupBy("class").agg(F.max("prob").alias("top"))
    one = d.join(tops, "class").filter("pos > 0 or prob = top")
    return one.select("class", F.when(F.col("pos") > 0, F.col("prob")).alias("threshold"), point(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), point(F.try_divide(F.col("tp"), F.col("pos"))).alias("recall"))


def consistency_checks(long: DataFrame) -> DataFrame:
    """Alerts (check, class, alert): counts that don't add up, few items, low or no support, all F1 of 1."""
    m = class_metrics(long)
    n = long.agg(F.count_distinct("id").alias("n"))
    per = m.crossJoin(F.broadcast(n))  # one row
    row = lambda name, cond: F.when(cond, F.lit(name))
    alerts = F.array(
        row("counts", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") != F.col("n")), row("no_support", F.col("support") == 0), row("low_support", F.col("support").between(1, 4))
    )
    out = per.select(F.explode(F.filter(alerts, lambda x: x.isNotNull())).alias("check"), "class")
    few = n.filter("n < 30").select(F.lit("few_items").alias("check"), F.lit("all").alias("class"))
    perfect = m.agg(F.min(F.coalesce("f1", F.lit(0.0))).alias("f")).filter("f = 1").select(F.lit("all_perfect").alias("check"), F.lit("all").alias("class"))
    return out.unionByName(few).unionByName(perfect)


# Poisson(1): a replicate counts an item as often as steps of the distribution lie at or below a 32-bit number.
POISSON = [int(2**32 * math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(13)]
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: multipliers of the 64-bit finaliser
REPLICATE = 0x9E3779B97F4A7C15  # odd: what a replicate's number is multiplied by
LEAST_VALID = 50  # replicates in which a figure must be defined for an interval


def poisson_weights(items: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Weights of items (64-bit keys) in replicates 0..n-1, from a hash of item, replicate and seed: reruns agree, however
    the items are dealt over tasks."""
    x = items.astype(np.uint64)[:, None] + np.arange(seed, seed + n, dtype=np.uint64)[None] * np.uint64(REPLICATE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    u = (x ^ (x >> np.uint64(31))) >> np.uint64(32)
    return np.searchsorted(np.array(POISSON, np.uint64), u, side="right")


def bootstrap_counts(long: DataFrame, n: int, seed: int, classes: list[str]) -> DataFrame:
    """replicate, items (weights of all), same (of items right in every class), tp, fp, fn (arrays by class)."""
    k = len(classes)
    key = F.col("id").cast("long") if dict(long.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("id")
    place = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))))
    bit = lambda c: F.sum(F.col(c).cast("long") * F.pow(F.lit(2.0), place[F.col("class")]).cast("long"))
    wide = long.groupBy(key.alias("key"), "id").agg(bit("y").alias("y"), bit("pred").alias("p"))

    def run(batches):
        total = np.zeros((n, 2 + 3 * k), np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                cols = [part.column(c).to_numpy() for c in range(3)]
                y, p = ((c[:, None] >> np.arange(k)) & 1 for c in cols[1:])
                marks = np.concatenate((np.ones((len(y), 1)), (y == p).all(1, keepdims=True), y & p, (1 - y) & p, y & (1 - p)), axis=1)
                total += (poisson_weights(cols[0], n, seed).T.astype(np.float64) @ marks).astype(np.int64)  # whole numbers far below 2**53
        split = lambda a, z: pa.array(list(total[:, a:z]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total[:, 0]), pa.array(total[:, 1]), *(split(2 + i * k, 2 + (i + 1) * k) for i in range(3))], names=["replicate", "items", "same", "tp", "fp", "fn"])

    parts = wide.select("key", "y", "p").mapInArrow(run, "replicate long, items long, same long, tp array<long>, fp array<long>, fn array<long>")
    sums = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(k))).alias(c)
    return parts.groupBy("replicate").agg(F.sum("items").alias("items"), F.sum("same").alias("same"), sums("tp"), sums("fp"), sums("fn"))


def bootstrap(long: DataFrame, n: int = 2000, seed: int = 42, classes=CLASSES) -> DataFrame:
    """95 % intervals (metric, class, valid, lower, upper) by a Poisson bootstrap of the items: macro and micro F1, exact match,
    Hamming loss (class ``all``) and precision, recall and F1 of each class.

    An item's weight in a replicate is hashed from both, so every task adds up its items' weighted counts for all replicates
    and one aggregate of (tasks x replicates) rows gives the replicates' counts; items are neither collected nor copied.
    Undefined ratios are 0 in the global figures.  A class's replicate counts for recall where it has positives, for
    precision where anything is predicted, for F1 where either holds.  A figure with fewer than LEAST_VALID replicates has
    null bounds; under 5 items or 10 replicates there are no rows."""
    classes = list(classes)
    if n < 10 or len(long.select("id").distinct().limit(5).collect()) < 5:
        return long.sparkSession.createDataFrame([], "metric string, class string, valid long, lower double, upper double")
    c = bootstrap_counts(long, n, seed, classes).filter("items > 0")
    k, at = len(classes), lambda name, i: F.col(name)[i].cast("double")
    f1 = lambda tp, fp, fn: F.try_divide(2 * tp, 2 * tp + fp + fn)
    total = lambda name: sum((at(name, i) for i in range(1, k)), at(name, 0))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    figures = [
        ("macro_f1", "all", sum((z(f1(at("tp", i), at("fp", i), at("fn", i))) for i in range(k)), F.lit(0.0)) / k),
        ("micro_f1", "all", z(f1(total("tp"), total("fp"), total("fn")))),
        ("exact_match", "all", F.col("same") / F.col("items")),
        ("hamming_loss", "all", (total("fp") + total("fn")) / (F.col("items") * k)),
    ]
    for i, name in enumerate(classes):
        tp, fp, fn = at("tp", i), at("fp", i), at("fn", i)
        figures += [("precision", name, F.try_divide(tp, tp + fp)), ("recall", name, F.try_divide(tp, tp + fn)), ("f1", name, f1(tp, fp, fn))]
    rows = c.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(s).alias("class"), v.alias("value")) for m, s, v in figures))).alias("r")).select("r.*")
    enough = F.count("value") >= LEAST_VALID
    bound = lambda q, name: F.when(enough, R4(F.percentile("value", F.lit(q)))).alias(name)
    return rows.groupBy("metric", "class").agg(F.count("value").alias("valid"), bound(0.025, "lower"), bound(0.975, "upper"))


def long_form(items: DataFrame, y: str, pred: str, prob: str | None = None, classes=CLASSES) -> DataFrame:
    """Arrays per item (id, y, pred, prob) to the long form."""
    arrays = [F.col(y).alias("y"), F.col(pred).alias("pred")] + ([F.col(prob).alias("prob")] if prob else [])
    z = F.arrays_zip(F.array(*map(F.lit, classes)).alias("class"), *arrays)
    return items.select("id", F.explode(z).alias("z")).select("id", "z.*")


def class_table(long: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """The report's table of the active classes: metrics, curves and thresholds side by side, one row a class."""
    out = class_metrics(long).join(average_precision(long), "class").join(roc_auc(long), "class")
    return out.join(thresholds.select("class", "threshold"), "class", "left") if thresholds is not None else out


def global_table(long: DataFrame) -> DataFrame:
    """The report's global metrics, one row each."""
    g = global_metrics(long)
    return g.select(F.explode(F.create_map(*(x for c in g.columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value"))


def compare_models(results: dict[str, DataFrame], gold: DataFrame, minimum_recall: float = 0.90, k: int = 10) -> DataFrame:
    """Calibrated threshold and ranking of several models' results on the same gold standard: one row a model."""
    out = None
    for name, res in results.items():
        one = calibrate(res, gold, minimum_recall).crossJoin(ranking_metrics(res, gold, k).select("ndcg")).withColumn("model", F.lit(name))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def benchmark_models(results: dict[str, DataFrame], gold: DataFrame, minimum_recall: float = 0.90, k: int = 10) -> DataFrame:
    """compare_models() with what computing each model's results took: rows, seconds, rows_per_second, measured one after the
    other by a tracked run into no sink."""
    from .progress import measure

    spark = gold.sparkSession
    took = [(name, m["rows"], m["seconds"], m["rows_per_second"]) for name, m in ((n, measure(df)) for n, df in results.items())]
    figures = spark.createDataFrame(took, "model string, rows long, seconds double, rows_per_second double")  # one row a model
    return compare_models(results, gold, minimum_recall, k).join(F.broadcast(figures), "model")
