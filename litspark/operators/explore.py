"""Corpus descriptors, terms and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, word_count


def descriptors(paragraphs: DataFrame) -> DataFrame:
    """(article_id, text) -> one row of counts and words per paragraph and document; empty gives zeros."""
    per = paragraphs.select("article_id", word_count("text").alias("w"))
    docs = per.groupBy("article_id").agg(F.sum("w").alias("words"), F.count("*").alias("paras"))
    z = lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 4)
    a = docs.agg(F.count("*").alias("n_documents"), z(F.avg("words")).alias("mean_words_per_doc"), z(F.avg("paras")).alias("mean_paras_per_doc"))
    b = per.agg(
        F.count("*").alias("n_paragraphs"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("total_words"), z(F.median("w")).alias("median_words"),
        z(F.stddev_pop("w")).alias("std_words"), F.coalesce(F.min("w"), F.lit(0)).cast("long").alias("min_words"), F.coalesce(F.max("w"), F.lit(0)).cast("long").alias("max_words"),
    )
    return a.crossJoin(b)  # one row each


def top_terms(paragraphs: DataFrame, n: int = 50) -> DataFrame:
    t = paragraphs.select(F.explode(tokens("text")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def _frequent(paragraphs: DataFrame, level: str, n: int, one_row: bool) -> DataFrame:
    """The n terms of greatest document frequency: term, weight.  Where a unit is one row its distinct terms are counted as
    they are; only units of several rows need their (unit, term) pairs brought together."""
    if one_row:
        rows = paragraphs.select(F.explode(F.array_distinct(tokens("text"))).alias("term"))
    else:
        unit = "article_id" if level == "document" else "paragraph_id"
        rows = paragraphs.select(F.col(unit).alias("unit"), F.explode(F.array_distinct(tokens("text"))).alias("term")).distinct()
    return rows.groupBy("term").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "term").limit(n)


def cooccurrence(paragraphs: DataFrame, level: str = "document", top_n: int = 30, minimum: int = 2, one_row: bool | None = None) -> DataFrame:
    """Edges (a < b, weight) between the top_n terms by document frequency: units that hold both, at least minimum.

    The top terms are collected and each row keeps its own of them before anything is exploded or moved.  one_row: whether a
    unit is one row; by default paragraphs are and documents are not."""
    one_row = level != "document" if one_row is None else one_row
    top = [r.term for r in _frequent(paragraphs, level, top_n, one_row).collect()]  # top_n terms
    held = F.array_intersect(tokens("text"), F.array(*map(F.lit, top)).cast("array<string>"))
    sets = paragraphs.select(F.array_sort(held).alias("t"), *([] if one_row else [F.col("article_id" if level == "document" else "paragraph_id").alias("unit")]))
    if not one_row:
        sets = sets.select("unit", F.explode("t").alias("term")).groupBy("unit").agg(F.array_sort(F.collect_set("term")).alias("t"))  # at most top_n a unit
    pairs = F.flatten(F.transform("t", lambda x: F.transform(F.filter("t", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    edges = sets.filter(F.size("t") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))
    return edges.filter(F.col("weight") >= minimum)


def cooccurrence_nodes(paragraphs: DataFrame, level: str = "document", top_n: int = 30, one_row: bool | None = None) -> DataFrame:
    return _frequent(paragraphs, level, top_n, level != "document" if one_row is None else one_row)


def cooccurrence_matrix(paragraphs: DataFrame, level: str = "document", top_n: int = 30, one_row: bool | None = None) -> DataFrame:
    """Symmetric matrix with a zero diagonal, one row and one column per term."""
    edges = cooccurrence(paragraphs, level, top_n, 1, one_row)
    terms = [r.term for r in cooccurrence_nodes(paragraphs, level, top_n, one_row).collect()]
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    nodes = paragraphs.sparkSession.createDataFrame([(t,) for t in terms], "a string")
    out = nodes.join(both, "a", "left").groupBy("a").pivot("b", terms).agg(F.sum("weight"))
    return out.na.fill(0).withColumnRenamed("a", "term")


def repeated_lines(pages: DataFrame, ratio: float = 0.4, least: int = 2, min_pages: int = 3) -> DataFrame:
    """Headers and footers: first or last non-empty lines (over five characters, not all digits) on at least
    max(least, int(ratio * pages)) pages of an article: (article_id, line, n)."""
    lines = F.filter(F.transform(F.split("text", "\\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("article_id", lines.alias("lines")).withColumn("lines", F.filter(F.array(F.get("lines", F.lit(0)), F.get("lines", F.size("lines") - 1)), lambda x: x.isNotNull()))
    sizes = pages.groupBy("article_id").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    long = rows.select("article_id", F.explode("lines").alias("line")).filter((F.length("line") > 5) & ~F.col("line").rlike("^\\d+$"))
    counts = long.groupBy("article_id", "line").agg(F.count("*").alias("n"))
    return counts.join(sizes, "article_id").filter(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * ratio + 1e-9))).select("article_id", "line", "n")


def drop_repeated_lines(pages: DataFrame, ratio: float = 0.4, least: int = 2) -> DataFrame:
    """pages (article_id, page, text) without every line equal to a repeated header or footer."""
    found = repeated_lines(pages, ratio, least).groupBy("article_id").agg(F.collect_set("line").alias("bad"))
    kept = F.array_join(F.filter(F.split("text", "\\n"), lambda x: ~F.coalesce(F.array_contains("bad", F.trim(x)), F.lit(False))), "\n")
    return pages.join(found, "article_id", "left").select("article_id", "page", kept.alias("text"))
