"""From page texts to Markdown and segments: metadata, cleaning, references, front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.segment import markdown_segments
from ..sources.writers import article_markdown
from .explore import drop_repeated_lines
from .references import decisions, remove_references


def metadata(articles: DataFrame) -> DataFrame:
    """articles (source_pdf, content, pages, title, author, creation_date) -> article_id and what is known of each, with
    a warning for every field that was not found."""
    page = lambda i: F.coalesce(F.get("pages", F.lit(i)).text, F.lit(""))
    three = F.concat_ws("\n", page(0), page(1), page(2))
    a = articles.withColumn("pdf_sha256", F.sha2("content", 256))
    doi, year, who = T.first_doi(three), T.first_year(page(0), creation_date="creation_date"), T.authors(F.coalesce("author", F.lit("")))
    stem = F.regexp_replace("source_pdf", "\\.[^.]+$", "")
    out = a.select(
        T.article_id("content").alias("article_id"), T.title(page(0), F.coalesce("title", F.lit("")), stem).alias("title"), who.alias("authors"), doi.alias("doi"), year.alias("year"),
        T.journal(page(0)).alias("journal"), T.language(F.concat_ws(" ", page(0), page(1))).alias("language"), "source_pdf", "pdf_sha256", "pages",
    )
    missing = [F.when(F.col("doi").isNull(), "doi not found"), F.when(F.col("year").isNull(), "year not found"), F.when(F.size("authors") == 0, "authors not found")]
    return out.withColumn("metadata_warnings", F.filter(F.array(*missing), lambda x: x.isNotNull()))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Normalised text with recomposed words, without repeated headers and footers."""
    return drop_repeated_lines(pages.withColumn("text", T.recompose_hyphens(T.normalize_text("text"))))


def process(articles: DataFrame, threshold: float = 0.60) -> DataFrame:
    """The library's path: metadata, cleaning, references, Markdown; status error where no page has text."""
    meta = metadata(articles)
    pages = meta.select("article_id", F.explode("pages").alias("p")).select("article_id", "p.page", "p.text")
    clean = clean_pages(pages)
    kept = remove_references(clean, threshold).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    found = decisions(clean, threshold).select("article_id", "references_removed", F.when(F.col("references_removed"), F.col("start_page")).alias("reference_start_page"))
    out = meta.drop("pages").join(found, "article_id", "left").join(kept, "article_id", "left")
    fields = [c for c in out.columns if c != "pages"]
    out = out.select("article_id", F.struct(*fields).alias("metadata"), F.coalesce("pages", F.array().cast("array<struct<page:int,text:string>>")).alias("pages"))
    out = article_markdown(out)
    chars = F.aggregate("pages", F.lit(0), lambda s, p: s + F.length(F.trim(p.text)))
    return out.withColumn("char_count", chars).withColumn("status", F.when(chars > 0, "success").otherwise("error"))


def segments(processed: DataFrame, **limits) -> DataFrame:
    return markdown_segments(processed.filter("status = 'success'").select("article_id", F.col("markdown").alias("text")), **limits)
