"""Multi-anchor cosine search and what is read off its results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import centroid, collect_anchors, similarities, unit
from .ranking import global_rank

# States that a search leaves out.
INVALID = ("error", "deleted", "invalid_segment", "failed")
PLACES = 6  # scores are compared and ranked rounded, so ranks don't depend on summation order


def valid_segments(df: DataFrame, articles: list | None = None) -> DataFrame:
    out = df.filter(~F.coalesce(F.col("status"), F.lit("")).isin(*INVALID)) if "status" in df.columns else df
    return out.filter(F.col("article_id").isin(*articles)) if articles else out


def aggregate(sims, strategy: str, weights: list[float], center: Column | None = None) -> Column:
    """One score of an array of similarities; weights that sum to zero give the mean, a missing centroid the maximum."""
    s = F.col(sims) if isinstance(sims, str) else sims
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    if strategy == "mean":
        return mean
    if strategy == "weighted_mean":
        total = float(sum(weights))
        w = F.array(*(F.lit(float(x)) for x in weights))
        return mean if total == 0 else F.aggregate(F.zip_with(s, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / total
    if strategy == "centroid" and center is not None:
        return center
    if strategy not in ("maximum", "centroid"):
        raise ValueError(f"unknown strategy {strategy}")
    return F.array_max(s)


def anchor_scores(df: DataFrame, anchors: DataFrame, strategy: str = "maximum") -> DataFrame:
    """df (.., embedding) with sims, anchor_scores (map), best_anchor_id (of equals the first) and aggregate_score."""
    rows = collect_anchors(anchors)
    if not rows:
        return df.limit(0).select("*", F.lit(None).cast("map<string,double>").alias("anchor_scores"), F.lit(None).cast("string").alias("best_anchor_id"), F.lit(None).cast("double").alias("aggregate_score"))
    matrix = np.array([r.embedding for r in rows], dtype=np.float64)
    if strategy == "centroid":
        matrix = np.concatenate((unit(matrix), centroid(matrix)[None]))
    out = df.withColumn("_all", similarities(F.col("embedding"), matrix)).filter("_all is not null")
    out = out.withColumn("_raw", F.slice("_all", 1, len(rows))).withColumn("sims", F.transform("_raw", lambda x: F.round(x, PLACES)))
    center = F.get("_all", F.lit(len(rows))) if strategy == "centroid" else None
    ids = F.array(*(F.lit(r.anchor_id) for r in rows))
    best = F.get(ids, (F.array_position("sims", F.array_max("sims")) - 1).cast("int"))
    score = F.round(aggregate("_raw", strategy, [r.weight for r in rows], center), PLACES)
    return out.select(*df.columns, F.map_from_arrays(ids, "sims").alias("anchor_scores"), best.alias("best_anchor_id"), score.alias("aggregate_score"))


def consolidate_chunks(results: DataFrame, how: str = "maximum") -> DataFrame:
    """One row per (article, paragraph): its best chunk; how='mean' replaces the score by the chunks' mean."""
    keys = ["article_id", "paragraph_id"]
    row = F.struct(*(F.col(c) for c in results.columns))
    order = F.struct(F.col("aggregate_score"), -F.col("chunk_index"))
    out = results.groupBy(*keys).agg(F.max_by(row, order).alias("_row"), F.avg("aggregate_score").alias("_mean"))
    cols = [F.round("_mean", PLACES + 3).alias(c) if c == "aggregate_score" and how == "mean" else F.col(f"_row.{c}").alias(c) for c in results.columns]
    return out.select(*cols)


def adjacent(df: DataFrame, text: str = "text", gap_free: bool = False) -> DataFrame:
    """The texts before and after each row of (article_id, idx); gap-free indexes need no join."""
    if gap_free:
        w = Window.partitionBy("article_id").orderBy("idx")
        return df.withColumn("context_before", F.lag(text).over(w)).withColumn("context_after", F.lead(text).over(w))
    near = lambda shift, name: df.select("article_id", (F.col("idx") + shift).alias("idx"), F.col(text).alias(name))
    return df.join(near(1, "context_before"), ["article_id", "idx"], "left").join(near(-1, "context_after"), ["article_id", "idx"], "left")


def multi_anchor_search(
    segments: DataFrame, anchors: DataFrame, strategy: str = "maximum", threshold: float = 0.5, articles: list | None = None,
    only_retained: bool = False, chunk_aggregation: str | None = None, ties: tuple = ("article_id", "paragraph_id"), ranked: bool = True,
) -> DataFrame:
    """The flagship query: filter, similarities, aggregate, threshold, consolidate, rank.  Ranking sorts all rows; what needs
    only scores goes without."""
    out = anchor_scores(valid_segments(segments, articles), anchors, strategy)
    out = out.withColumn("selected", F.col("aggregate_score") >= threshold)
    if only_retained:
        out = out.filter("selected")
    if chunk_aggregation:
        out = consolidate_chunks(out, chunk_aggregation)
    return global_rank(out, "aggregate_score", *ties) if ranked else out


def top_k(segments: DataFrame, anchors: DataFrame, k: int = 10, threshold: float = 0.0, articles: list | None = None) -> DataFrame:
    """The k best rows for one query; the threshold only marks rows."""
    out = anchor_scores(valid_segments(segments, articles), anchors)
    out = out.withColumn("selected", F.col("aggregate_score") >= threshold)
    best = out.orderBy(F.desc("aggregate_score"), "article_id", "paragraph_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("aggregate_score"), "article_id", "paragraph_id")))


def summary(results: DataFrame) -> DataFrame:
    """Counts, retention and the retained scores' figures: one row."""
    kept = F.when(F.col("selected"), F.col("aggregate_score"))
    r4 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return results.agg(
        F.count("*").alias("n_total"), F.count_if("selected").alias("n_retained"), F.count_if(~F.col("selected")).alias("n_discarded"),
        r4(F.expr("try_divide(100.0D * count_if(selected), count(*))")).alias("retention_pct"),
        r4(F.avg(kept)).alias("mean_score"), r4(F.median(kept)).alias("median_score"), r4(F.min(kept)).alias("min_score"), r4(F.max(kept)).alias("max_score"),
    )


def per_anchor_statistics(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per anchor: score figures, paragraphs and documents at or above the threshold, and how often it is the best."""
    long = results.select("article_id", "paragraph_id", "best_anchor_id", F.explode("anchor_scores").alias("anchor_id", "s"))
    hit = F.col("s") >= threshold
    totals = results.agg(F.count_distinct("paragraph_id").alias("all_p"), F.count_distinct("article_id").alias("all_d"))
    out = long.groupBy("anchor_id").agg(
        F.round(F.avg("s"), 4).alias("mean_score"), F.round(F.median("s"), 4).alias("median_score"), F.round(F.min("s"), 4).alias("min_score"),
        F.round(F.max("s"), 4).alias("max_score"), F.round(F.stddev_pop("s"), 4).alias("std_score"),
        F.count_distinct(F.when(hit, F.col("paragraph_id"))).alias("n_paragraphs"), F.count_distinct(F.when(hit, F.col("article_id"))).alias("n_documents"),
        F.count_if(F.col("best_anchor_id") == F.col("anchor_id")).alias("times_best"),
    )
    pct = lambda n, total: F.round(F.coalesce(F.try_divide(100.0 * F.col(n), F.col(total)), F.lit(0.0)), 2)
    return out.crossJoin(F.broadcast(totals)).withColumn("pct_paragraphs", pct("n_paragraphs", "all_p")).withColumn("pct_documents", pct("n_documents", "all_d")).drop("all_p", "all_d")  # one row


def sensitivity_curve(results: DataFrame, points: int = 50) -> DataFrame:
    """Rows at or above each of points + 1 thresholds from 0 to 1: one histogram pass and a running sum."""
    cell = F.floor(F.col("aggregate_score") * points + 1e-9)
    hist = results.groupBy(F.least(F.greatest(cell, F.lit(-1)), F.lit(points)).cast("int").alias("i")).agg(F.count("*").alias("n"))
    grid = results.sparkSession.range(-1, points + 1).select(F.col("id").cast("int").alias("i"))
    w = Window.orderBy(F.desc("i"))
    out = grid.join(hist, "i", "left").withColumn("retained", F.sum(F.coalesce("n", F.lit(0))).over(w))
    out = out.withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy()))
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("retained"), F.col("total")), F.lit(0.0)), 4)
    return out.filter("i >= 0").select((F.col("i") / float(points)).alias("threshold"), F.col("retained").cast("long").alias("retained"), pct.alias("pct"))


def histogram(df: DataFrame, value: str, bins: int = 30, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Rows per equal-width bin; values outside fall into the end bins."""
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """N, mean, median, sample deviation (0 for one value), extremes and quartiles; NaN and null left out."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"))
    r = lambda c: F.round(c, 4)
    q = lambda p: r(F.percentile("v", F.lit(p)))
    return v.agg(
        F.count("*").alias("n"), r(F.avg("v")).alias("mean"), r(F.median("v")).alias("median"), r(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("std"),
        r(F.min("v")).alias("min"), r(F.max("v")).alias("max"), q(0.25).alias("p25"), q(0.75).alias("p75"),
    )


def attach_scores(corpus: DataFrame, results: DataFrame, name: str = "semantic_score") -> DataFrame:
    """corpus (article_id, paragraph_id) with the aggregate_score of its paragraph in results: of the same article, else of
    any with that paragraph_id (the last by rank), else 0.0."""
    r = results.withColumn("_rank", F.col("rank") if "rank" in results.columns else F.lit(0))
    own = r.groupBy("article_id", "paragraph_id").agg(F.max_by("aggregate_score", "_rank").alias("_own"))
    any_article = r.groupBy("paragraph_id").agg(F.max_by("aggregate_score", F.struct("_rank", "article_id")).alias("_any"))
    rows = corpus.drop(name).join(own, ["article_id", "paragraph_id"], "left").join(any_article, "paragraph_id", "left")
    return rows.withColumn(name, F.coalesce("_own", "_any", F.lit(0.0))).select(*[c for c in corpus.columns if c != name], name)
