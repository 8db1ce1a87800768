"""Methodology reports from result tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists
from ..sources.writers import load_manifest, markdown_table, save_manifest

SECTIONS = (
    "Objective", "Corpus", "Extraction", "Cleaning", "References", "Segmentation", "Embeddings", "Semantic search", "Threshold", "Annotation",
    "Agreement", "Classifier", "Evaluation", "Index", "Structured extraction", "Funnel",
)


def methodology(run_id: str, config: dict, tables: dict[str, DataFrame]) -> str:
    """One Markdown document: every section with its settings and its table, or a note that it was not run."""
    out = [f"# Methodology report {run_id}", ""]
    for i, name in enumerate(SECTIONS, 1):
        out += [f"## {i}. {name}", ""]
        settings = config.get(name)
        out += [f"- {k}: {v}" for k, v in (settings or {}).items()]
        out += ["", markdown_table(tables[name]) if name in tables else "Not run.", ""]
    return "\n".join(out)


def experiment_counts(segments: DataFrame) -> DataFrame:
    from .corpus import status_counts

    return status_counts(segments, "status", "exclusion_reason" if "exclusion_reason" in segments.columns else None)


# ---------------------------------------------------------------- experiment runs
def run_id(now: datetime | None = None) -> str:
    return f"exp_{now or datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:4]}"


def flat_results(results: DataFrame, anchor_ids: list[str]) -> DataFrame:
    """Search results with one column Similarity_<id> for every anchor in place of the map."""
    scores = [F.round(F.col("anchor_scores")[a], 4).alias(f"Similarity_{a}") for a in anchor_ids]
    return results.select(*(c for c in results.columns if c != "anchor_scores"), *scores)


def save_experiment(
    spark: SparkSession, path: str, run: str, config: dict, segments: DataFrame, results: DataFrame, anchors: list[dict],
    environment: dict | None = None, metrics: dict | None = None, times: dict | None = None, preview: int = 50,
) -> dict:
    """Write a run under path/run, which must not exist: config, environment, anchors, metrics (if any), results as CSV and
    Parquet, METHODS.md and, last, the manifest with the audit counts, which it returns.  Results are written by Spark, whole;
    the Markdown shows the first ``preview`` by rank."""
    at = f"{path}/{run}"
    if path_exists(spark, f"{at}/manifest"):
        raise FileExistsError(at)
    valid = F.col("status") == "valid_paragraph"
    c = segments.agg(F.count_distinct("article_id").alias("a"), F.count("*").alias("n"), F.count_if(valid).alias("v")).first()
    reasons = experiment_counts(segments.filter(~F.coalesce(valid, F.lit(False)))).collect()  # one row a reason
    flat = flat_results(results, [a["id"] for a in anchors])
    flat.write.mode("overwrite").parquet(f"{at}/results")
    written = spark.read.parquet(f"{at}/results")
    written.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{at}/results_csv")
    for name, content in (("config", config), ("environment", environment or {}), ("semantic_references", {"anchors": anchors}), *([("metrics", metrics)] if metrics else [])):
        save_manifest(spark, f"{at}/{name}", content)
    manifest = {
        "run_id": run, "config": config, "semantic_references": anchors, "total_articles": c.a, "total_paragraphs": c.n, "valid_paragraphs": c.v, "excluded_paragraphs": c.n - c.v,
        "selected_paragraphs": written.filter("selected").count() if "selected" in written.columns else written.count(), "exclusion_reasons": {r.status or "unknown": r.n for r in reasons},
        **{k: float((times or {}).get(k, 0.0)) for k in ("processing_time_seconds", "embedding_time_seconds", "similarity_time_seconds", "paragraphs_per_second")},
    }
    best = written.orderBy("rank").limit(preview) if "rank" in written.columns else written.limit(preview)
    counts = [f"- {k}: {manifest[k]}" for k in ("total_articles", "total_paragraphs", "valid_paragraphs", "excluded_paragraphs", "selected_paragraphs")]
    lines = [f"# Run {run}", "", *(f"- {k}: {v}" for k, v in sorted(config.items())), "", "## Anchors", "", *(f"- {a['id']}: {a['text']} (weight {a['weight']})" for a in anchors)]
    lines += ["", "## Counts", "", *counts, "", f"## First {preview} results", "", markdown_table(best, preview)]
    spark.createDataFrame([("\n".join(lines) + "\n",)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/METHODS.md")
    save_manifest(spark, f"{at}/manifest", manifest)
    return manifest


def load_experiment(spark: SparkSession, path: str, run: str) -> tuple[dict, DataFrame]:
    """Manifest and results of a whole run; FileNotFoundError without its manifest."""
    at = f"{path}/{run}"
    if not path_exists(spark, f"{at}/manifest"):
        raise FileNotFoundError(at)
    return load_manifest(spark, f"{at}/manifest"), spark.read.parquet(f"{at}/results")
