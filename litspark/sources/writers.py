"""Sinks: corpora, candidates, annotation forms, reports and stage tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import CLASSES

FORMATS = ("parquet", "csv", "jsonl", "markdown")


def flatten_probabilities(df: DataFrame) -> DataFrame:
    """prob_<class> columns, the greatest probability and the labels as text ('Nenhum' for none)."""
    probs = [F.round(F.coalesce(F.col("probabilities")[c], F.lit(0.0)), 4).alias(f"prob_{c}") for c in CLASSES]
    labels = F.when(F.size("predicted_labels") > 0, F.array_join("predicted_labels", ", ")).otherwise("Nenhum")
    rest = [c for c in df.columns if c not in ("probabilities", "predicted_labels", "embedding")]
    return df.select(*rest, labels.alias("labels"), *probs, F.round(F.array_max(F.map_values("probabilities")), 4).alias("max_probability"))


def flatten_similarities(df: DataFrame, anchors: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "anchor_scores"], *(F.round(F.col("anchor_scores")[a], 4).alias(f"Similarity_{a}") for a in anchors))


def markdown_lines(df: DataFrame) -> DataFrame:
    """One Markdown section per row."""
    rest = [c for c in df.columns if c not in ("text", "embedding")]
    head = F.concat_ws("\n", *(F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rest))
    return df.select(F.concat(F.lit("## "), F.col(rest[0]).cast("string"), F.lit("\n\n"), head, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n---\n")).alias("value"))


def export(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "jsonl":
        df.write.mode(mode).json(path)
    elif kind == "csv":
        flat = flatten_probabilities(df) if {"probabilities", "predicted_labels"} <= set(df.columns) else df
        simple = [F.col(c) if "<" not in t else F.to_json(c).alias(c) for c, t in flat.dtypes]
        flat.select(*simple).write.mode(mode).option("header", "true").csv(path)
    elif kind == "markdown":
        markdown_lines(df).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def article_markdown(articles: DataFrame) -> DataFrame:
    """articles (metadata struct, pages) -> the Markdown of each: front matter, then every page after its marker."""
    meta = F.concat_ws("\n", *(F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"metadata.{f}").cast("string"), F.lit("null"))) for f in articles.schema["metadata"].dataType.names))
    pages = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("<!-- page: "), p.page.cast("string"), F.lit(" -->\n\n"), F.trim(p.text))), "\n\n")
    return articles.withColumn("markdown", F.concat(F.lit("---\n"), meta, F.lit("\n---\n\n"), pages, F.lit("\n")))


def write_per_article(df: DataFrame, path: str) -> None:
    """One partition per article; articles in df replace theirs, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("article_id").parquet(path)


def save_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON document through Spark's commit protocol."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_stage(df: DataFrame, root: str, stage: str, config: dict | None = None) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{stage}/data")
    save_manifest(df.sparkSession, f"{root}/{stage}/manifest", {"stage": stage, "config": config or {}, "columns": df.columns})


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A result of at most limit rows as a Markdown table; a longer one is an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table of more than {limit} rows")
    show = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
