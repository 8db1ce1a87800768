"""Removal of the list of references: headings, evidence, the best candidate, and the cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_reference_title, reference_evidence


def _articles(pages: DataFrame) -> DataFrame:
    """One row per article with its lines in order; an article's lines are bounded by one document."""
    row = F.struct("page", F.split(F.coalesce("text", F.lit("")), "\\n").alias("lines"))
    arts = pages.groupBy("article_id").agg(F.array_sort(F.collect_list(row)).alias("pages"))
    lines = F.flatten(F.transform("pages", lambda p, i: F.transform(p.lines, lambda x, k: F.struct(i.alias("at"), p.page.alias("page"), k.alias("line_no"), x.alias("line")))))
    return arts.withColumn("lines", lines)


def candidates(pages: DataFrame, whole_text: bool = False) -> DataFrame:
    """Headings that may open the references, on the later pages: article_id, at, page, line_no, line, confidence."""
    a = _articles(pages)
    n = F.size("pages")
    first = F.greatest(F.when(n <= 2, 1).otherwise(2), F.floor(n * 0.4 + 1e-9).cast("int"))
    where = F.transform("lines", lambda x, i: F.struct(x.at.alias("at"), x.page.alias("page"), x.line_no.alias("line_no"), x.line.alias("line"), i.alias("i")))
    heads = F.filter(where, lambda x: is_reference_title(x.line) & ((x.page >= first) | F.lit(whole_text)))
    h = a.select("article_id", "lines", n.alias("n"), F.explode(heads).alias("h"))
    rest = F.transform(F.slice("lines", F.col("h.i") + 2, F.size("lines")), lambda x: F.trim(x.line))
    after = F.slice(F.filter(rest, lambda x: x != ""), 1, 40)
    return h.select("article_id", "h.at", "h.page", "h.line_no", "h.line", reference_evidence(after, F.col("h.page") / F.col("n"), F.col("h.line")).alias("confidence"))


def decisions(pages: DataFrame, threshold: float = 0.60, whole_text: bool = False) -> DataFrame:
    """Per article: whether references are removed, the title found, its page, the confidence; of equal candidates the
    first."""
    best = candidates(pages, whole_text).groupBy("article_id").agg(
        F.max_by(F.struct("at", "page", "line_no", "line", "confidence"), F.struct("confidence", -F.col("at"), -F.col("line_no"))).alias("b")
    )
    out = pages.select("article_id").distinct().join(best, "article_id", "left")
    conf = F.coalesce("b.confidence", F.lit(0.0))
    return out.select(
        "article_id", (conf >= threshold).alias("references_removed"), F.trim("b.line").alias("detected_title"), F.col("b.page").alias("start_page"),
        F.round(conf, 2).alias("confidence"), F.when(conf >= threshold, "multi_factor_heuristic").otherwise("conservative_preservation").alias("method"), F.col("b.line_no").alias("line_no"),
    )


def remove_references(pages: DataFrame, threshold: float = 0.60, whole_text: bool = False, blank: str = "\\s", keep_emptied: bool = False) -> DataFrame:
    """pages (article_id, page, text) without what follows the heading; the pages after it go, and its own if nothing is left
    of it, unless keep_emptied.  blank is the class of characters that go from both ends of what is kept."""
    cut = decisions(pages, threshold, whole_text).filter("references_removed").select("article_id", "start_page", "line_no")
    out = pages.join(cut, "article_id", "left").filter("start_page is null or page <= start_page")
    kept = F.regexp_replace(F.array_join(F.slice(F.split("text", "\\n"), F.lit(1), F.col("line_no")), "\n"), f"(?U)\\A{blank}+|{blank}+\\z", "")
    here = F.coalesce(F.col("page") == F.col("start_page"), F.lit(False))
    out = out.withColumn("text", F.when(here, kept).otherwise(F.col("text")))
    return (out if keep_emptied else out.filter(~here | (F.col("text") != ""))).select("article_id", "page", "text")
