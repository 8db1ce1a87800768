"""The deduplicated vector index: an exact Parquet index with filtered top-k retrieval."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from .corpus import number_rows
from .search import PLACES
from ..functions.vectors import similarities
from ..sources.readers import path_exists
from ..sources.writers import save_manifest


def filter_and_deduplicate(corpus: DataFrame, order: str = "paragraph_id") -> DataFrame:
    """Relevant rows with labels, the first of each paragraph_id in the order given."""
    kept = corpus.filter((F.col("status") != "MODEL_NOT_RELEVANT") & (F.size("predicted_labels") > 0))
    value = F.struct(*(F.col(c) for c in kept.columns))
    return kept.groupBy("paragraph_id").agg(F.min_by(value, order).alias("_r")).select("_r.*")


def class_flags(df: DataFrame) -> DataFrame:
    for i, c in enumerate(CLASSES, 1):
        df = df.withColumn(f"class_{i}", F.array_contains("predicted_labels", c))
    return df


def build(corpus: DataFrame, vectors: DataFrame, order: str = "seq") -> DataFrame:
    """Rows of the index: refined paragraphs joined with their first vector, numbered 0..n-1; paragraphs without a vector
    are left out."""
    refined = filter_and_deduplicate(corpus, order)
    seq = "vec_seq" if "vec_seq" in vectors.columns else "embedding"  # without an order the least vector, so that reruns agree
    first = vectors.groupBy("paragraph_id").agg(F.min_by("embedding", seq).alias("embedding"))
    rows = refined.drop("embedding").join(first.select("paragraph_id", "embedding"), "paragraph_id")
    return number_rows(class_flags(rows), "faiss_id", order, "paragraph_id")


def checksum(rows: DataFrame) -> dict:
    """Number of vectors and a hash of all rows that doesn't depend on their order."""
    h = F.xxhash64(*sorted(rows.columns))
    r = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.pmod("h", F.lit(1 << 32))).alias("s")).first()
    return {"n_vectors": r.n, "checksum": hashlib.sha256(f"{r.n}|{r.x}|{r.s}".encode()).hexdigest()}


def _write_version(spark: SparkSession, path: str, version: int, parts: list[str], config: dict) -> dict:
    """The manifest is written last and under a name of its own: a version without one doesn't exist."""
    rows = spark.read.parquet(*(f"{path}/{p}" for p in parts))
    manifest = {"version": version, "parts": parts, "config": config, **checksum(rows)}
    save_manifest(spark, f"{path}/manifest-{version:06d}", manifest)
    return manifest


def versions(spark: SparkSession, path: str) -> list[dict]:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    try:
        rows = spark.read.text(f"{path}/manifest-*").collect()  # one row a version
    except AnalysisException:
        rows = []
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])


def save(index: DataFrame, path: str, config: dict) -> dict:
    """Write the index as the next version; earlier versions stay readable until the new one is whole."""
    spark = index.sparkSession
    have = versions(spark, path) if path_exists(spark, path) else []
    version = have[-1]["version"] + 1 if have else 1
    part = f"data-{version:06d}"
    index.write.mode("overwrite").parquet(f"{path}/{part}")  # of an attempt that left no manifest
    return _write_version(spark, path, version, [part], config)


def load(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, dict]:
    """The newest whole version and its manifest; FileNotFoundError where there is none or a part is missing, ValueError
    where the rows are not those that were written."""
    have = versions(spark, path)
    if not have:
        raise FileNotFoundError(f"{path}: no manifest")
    manifest = have[-1]
    for p in manifest["parts"]:
        if not path_exists(spark, f"{path}/{p}"):
            raise FileNotFoundError(f"{path}/{p}")
    rows = spark.read.parquet(*(f"{path}/{p}" for p in manifest["parts"]))
    if check and checksum(rows) != {k: manifest[k] for k in ("n_vectors", "checksum")}:
        raise ValueError("the index's rows don't agree with its checksum")
    return rows, manifest


def append(spark: SparkSession, path: str, rows: DataFrame, config: dict) -> dict:
    """Add vectors of the same model as a further part and version; another model is an error."""
    have, manifest = load(spark, path)
    if manifest["config"].get("model") != config.get("model"):
        raise ValueError("the index holds vectors of another model")
    top = have.agg(F.coalesce(F.max("faiss_id"), F.lit(-1)).alias("m")).first().m
    version = manifest["version"] + 1
    part = f"data-{version:06d}"
    number_rows(rows, "faiss_id", "paragraph_id", start=top + 1).select(*have.columns).write.mode("overwrite").parquet(f"{path}/{part}")
    return _write_version(spark, path, version, [*manifest["parts"], part], {**manifest["config"], "version": version})


def query(index: DataFrame, vector, k: int = 10, classes: list | None = None, min_score: float = -1.0, max_score: float = 1.0) -> DataFrame:
    """The k nearest rows by cosine that pass the filters, ranked from 1.  classes: numbers or class_<n>, all required;
    unknown ones are ignored."""
    rows = index
    for c in classes or ():
        name = c if str(c).startswith("class_") else f"class_{c}"
        if name in index.columns:
            rows = rows.filter(F.col(name))
    import numpy as np

    rows = rows.withColumn("score", F.round(similarities(F.col("embedding"), np.array([vector], dtype=float))[0], PLACES))
    if min_score > -1:
        rows = rows.filter(F.col("score") >= min_score)
    if max_score < 1:
        rows = rows.filter(F.col("score") <= max_score)
    best = rows.orderBy(F.desc("score"), "faiss_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "faiss_id")))  # k rows


def distribution(corpus: DataFrame) -> DataFrame:
    """Rows per class, distinct relevant paragraphs, label occurrences and shares, over refined rows."""
    rel = corpus.filter((F.col("status") != "MODEL_NOT_RELEVANT") & (F.size("predicted_labels") > 0))
    total = rel.agg(F.count_distinct("paragraph_id").alias("n_relevant"), F.coalesce(F.sum(F.size("predicted_labels")), F.lit(0)).cast("long").alias("n_occurrences"))
    per = rel.select(F.explode("predicted_labels").alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("n_occurrences"), 2))  # one row


def coverage(total_articles: DataFrame, refined: DataFrame) -> DataFrame:
    """Articles with relevant paragraphs and those paragraphs per article."""
    per = refined.groupBy("article_id").agg(F.count("*").alias("n"))
    z = lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 4)
    a = per.agg(F.count("*").alias("articles_with"), z(F.avg("n")).alias("mean"), z(F.median("n")).alias("median"), z(F.min("n")).alias("min"), z(F.max("n")).alias("max"))
    t = total_articles.agg(F.count_distinct("article_id").alias("articles"))
    return a.crossJoin(t).withColumn("coverage_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("articles_with"), F.col("articles")), F.lit(0.0)), 2))  # one row each
