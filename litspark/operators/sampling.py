"""Reproducible samples: a fixed hash order instead of a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_order

# Lower edges of the strata of stratified samples.
STRATA = (0.0, 0.4, 0.6, 0.75)


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def top_sample(df: DataFrame, n: int, score: str, key: str) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(n)


def _stratified(df: DataFrame, stratum, n: int, each: int, key: str, seed: int) -> DataFrame:
    """The first ``each`` rows of every stratum in hash order, then others in hash order until n; keys are unique.

    Both parts are bounded before anything is sorted: every task hands on ``each`` rows a stratum and its first n rows, as
    the first n rows hold as many that are not picked as can be needed."""
    rows = df.withColumn("_stratum", stratum).withColumn("_h", hash_order(key, seed))
    nth = F.row_number().over(Window.partitionBy("_stratum").orderBy("_h", key))
    picked = rows.filter("_stratum is not null").withColumn("_nth", nth).filter(F.col("_nth") <= each).drop("_nth")
    others = rows.orderBy("_h", key).limit(n).join(picked.select(key), key, "left_anti")
    both = picked.withColumn("_rest", F.lit(False)).unionByName(others.withColumn("_rest", F.lit(True)))
    return both.orderBy("_rest", "_h", key).limit(n).drop("_stratum", "_h", "_rest")


def stratified_sample(df: DataFrame, n: int, score: str, key: str, seed: int = 42) -> DataFrame:
    """Four fixed strata of the score, max(1, n div 4) of each; scores below 0 or null are in none."""
    s = F.col(score)
    stratum = F.when(s >= 0, sum(((s >= edge).cast("int") for edge in STRATA), F.lit(0)))
    return _stratified(df, stratum, n, max(1, n // 4), key, seed)


def stratified_by_similarity(df: DataFrame, n: int, score: str, key: str, strata: int = 5, seed: int = 42) -> DataFrame:
    """Equal-width strata between the least and the greatest score, n div strata of each; equal scores: one stratum."""
    edges = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    rows = df.crossJoin(F.broadcast(edges))  # one row
    width = (F.col("_hi") - F.col("_lo")) / strata
    stratum = F.when(width > 0, F.least(F.floor((F.col(score) - F.col("_lo")) / width), F.lit(strata - 1))).otherwise(0)
    return _stratified(rows, stratum, n, n // strata, key, seed).drop("_lo", "_hi")


def boundary_sample(df: DataFrame, n: int, score: str, key: str, threshold: float = 0.5, margin: float = 0.05, seed: int = 42) -> DataFrame:
    """Rows within the margin of the threshold in hash order; if there are none, the nearest."""
    gap = F.abs(F.col(score) - threshold)
    rows = df.withColumn("_gap", F.round(gap, 9)).withColumn("_in", (F.round(gap, 9) <= margin).cast("int"))
    any_in = rows.agg(F.coalesce(F.max("_in"), F.lit(0)).alias("_any"))
    rows = rows.crossJoin(F.broadcast(any_in)).filter("_any = 0 or _in = 1")  # one row
    order = F.when(F.col("_any") == 1, F.lit(0.0)).otherwise(F.col("_gap"))
    return rows.orderBy(order, hash_order(key, seed), key).limit(n).drop("_gap", "_in", "_any")


def uncertainty_sample(df: DataFrame, n: int, probabilities: str, key: str) -> DataFrame:
    """Least mean distance of the probabilities (a map) from one half first; without any the distance is 0."""
    p = F.map_values(probabilities)
    far = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.abs(x - 0.5)) / F.size(p)
    return df.withColumn("uncertainty", F.round(F.coalesce(F.when(F.size(p) > 0, far), F.lit(0.0)), 6)).orderBy("uncertainty", key).limit(n)


def unannotated_sample(df: DataFrame, annotated: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return random_sample(df.join(annotated.select(key).distinct(), key, "left_anti"), n, key, seed)


def group_split(df: DataFrame, group: str, ratios=(0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Whole groups to train, validation and test by their place in hash order; under three groups all train."""
    g = df.select(group).distinct().withColumn("_h", hash_order(group, seed))
    # two-level rank, so that no task orders all groups
    g = g.withColumn("_cell", F.substring("_h", 1, 3))
    counts = g.groupBy("_cell").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_cell", before.alias("_before"), total.alias("_total"))
    g = g.withColumn("_nth", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", group))).join(counts, "_cell")
    rank = F.col("_before") + F.col("_nth")
    held = F.ceil(F.round(F.col("_total") * (1 - ratios[0]), 6))
    test = F.ceil(F.round(held * (ratios[2] / (ratios[1] + ratios[2])), 6))
    split = (
        F.when(F.col("_total") < 3, "train").when(rank <= F.col("_total") - held, "train")
        .when(held < 2, "test").when(rank <= F.col("_total") - test, "val").otherwise("test")
    )
    return df.join(g.select(group, split.alias("split")), group)


def leakage(train: DataFrame, other: DataFrame) -> DataFrame:
    """Shared paragraph ids, trimmed texts and articles of two sets (paragraph_id, text, article_id)."""
    out = None
    for kind, value in (("paragraph_id", F.col("paragraph_id").cast("string")), ("text", F.trim("text")), ("article_id", F.col("article_id").cast("string"))):
        side = lambda d: d.select(value.alias("v")).filter("v is not null").distinct()  # noqa: B023, E731
        one = side(train).intersect(side(other)).agg(F.lit(kind).alias("kind"), F.count("*").alias("shared"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("alert", F.col("shared") > 0)
