"""Registries, upserts, duplicates, states, integrity and the funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NOT_RELEVANT
from .scan import numbered


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order given; an aggregate, so no key gathers its rows."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.struct(*order)).alias("_r")).select("_r.*")


def classify_batch(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """batch (source_filename, pdf_sha256) against the registry: duplicate by content, else an update by name, else new;
    with the article it matches."""
    by_hash = registry.groupBy("pdf_sha256").agg(F.min("article_id").alias("same"))
    by_name = registry.groupBy("source_filename").agg(F.min("article_id").alias("named"))
    out = batch.join(by_hash, "pdf_sha256", "left").join(by_name, "source_filename", "left")
    kind = F.when(F.col("same").isNotNull(), "duplicate").when(F.col("named").isNotNull(), "modified").otherwise("new")
    return out.select("source_filename", "pdf_sha256", kind.alias("kind"), F.coalesce("same", "named").alias("matches"))


def next_versions(classified: DataFrame, registry: DataFrame, policy: str = "version") -> DataFrame:
    """What a policy makes of a batch: skip drops duplicates; overwrite keeps the version; version adds one and names the
    article that is superseded."""
    top = registry.groupBy("article_id").agg(F.max("version_number").alias("v"))
    out = classified.join(top, classified.matches == top.article_id, "left").drop("article_id")
    if policy == "skip":
        out = out.filter("kind <> 'duplicate'")
    step = 1 if policy == "version" else 0
    version = F.when(F.col("kind") == "new", 1).otherwise(F.coalesce("v", F.lit(0)) + step)
    return out.select("source_filename", "kind", version.cast("int").alias("version_number"), F.when(F.col("kind") != "new", F.col("matches")).alias("supersedes"))


SLICE = 1024  # distinct hashes of a leaf of the hash tree, about


def corpus_hash(df: DataFrame, sha: str = "text_sha256", slice_rows: int = SLICE) -> DataFrame:
    """corpus_hash, n (rows): the root of a tree over the sorted distinct text hashes, each with its count.

    A leaf hashes the rows ``hash:count`` of one prefix; prefixes get a digit longer as often as the table's distinct hashes
    exceed slice_rows sixteenfold, so leaves stay as large and their number grows; an inner node hashes at most sixteen
    hashes.  Equal texts are one row with a count.  An empty table has the hash of nothing."""
    rows = df.groupBy(F.col(sha).alias("h")).agg(F.count("*").alias("n")).filter("h is not null")
    distinct, digits = df.select(sha).distinct().count(), 0
    while distinct > slice_rows * 16**digits:
        digits += 1
    join = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x.v), ""), 256)
    level = rows.select(F.substring("h", 1, digits).alias("p"), F.col("h").alias("k"), F.concat("h", F.lit(":"), F.col("n").cast("string")).alias("v"), "n")
    for d in range(digits, 0, -1):
        level = level.groupBy("p").agg(join.alias("v"), F.sum("n").alias("n")).select(F.substring("p", 1, d - 1).alias("p"), F.col("p").alias("k"), "v", "n")
    return level.agg(join.alias("corpus_hash"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def final_corpus(df: DataFrame) -> DataFrame:
    """FINAL_CORPUS, or any state that contains MODEL_RELEVANT."""
    return df.filter((F.col("status") == "FINAL_CORPUS") | F.contains("status", F.lit("MODEL_RELEVANT")))


def extraction_corpus(df: DataFrame) -> DataFrame:
    """What extraction may read: final or model-relevant rows, or rows with labels none of which is 'not relevant'."""
    labelled = (F.size("predicted_labels") > 0) & ~F.array_contains("predicted_labels", NOT_RELEVANT)
    return df.filter(F.col("status").isin("FINAL_CORPUS", "MODEL_RELEVANT") | F.coalesce(labelled, F.lit(False)))


def pending(articles: DataFrame, done: DataFrame, key: str = "article_id") -> DataFrame:
    """Articles without vectors yet."""
    return articles.join(done.select(key).distinct(), key, "left_anti")


def integrity(segments: DataFrame, vectors: DataFrame, key: str = "segment_id") -> DataFrame:
    """Counts that must agree, duplicates and orphans, and the worst status: critical, inconsistent, warning or valid."""
    dup = lambda d: d.groupBy(key).count().filter("count > 1").agg(F.count("*").alias("n"))
    orphan = lambda a, b: a.join(b.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    parts = [
        segments.agg(F.count("*").alias("n")), vectors.agg(F.count("*").alias("n")), dup(segments), dup(vectors), orphan(segments, vectors), orphan(vectors, segments),
    ]
    names = ("n_segments", "n_vectors", "duplicate_segments", "duplicate_vectors", "segments_without_vector", "vectors_without_segment")
    out = None
    for p, name in zip(parts, names):
        p = p.select(F.col("n").alias(name))
        out = p if out is None else out.crossJoin(p)  # one row each
    status = (
        F.when((F.col("n_segments") == 0) | (F.col("n_vectors") == 0), "critical")
        .when((F.col("n_segments") != F.col("n_vectors")) | (F.col("duplicate_segments") > 0) | (F.col("duplicate_vectors") > 0), "inconsistent")
        .when((F.col("segments_without_vector") > 0) | (F.col("vectors_without_segment") > 0), "warning").otherwise("valid")
    )
    return out.withColumn("status", status)


def status_counts(df: DataFrame, column: str = "status", reason: str | None = None) -> DataFrame:
    value = F.coalesce(F.col(reason), F.col(column)) if reason else F.col(column)
    return df.groupBy(value.alias("status")).agg(F.count("*").alias("n"))


def funnel(spark, stages: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(stage, input, output) -> n_in, n_out, removed and retention; an empty input retains 100 %."""
    out = None
    for i, (name, a, b) in enumerate(stages):
        one = a.agg(F.count("*").alias("n_in")).crossJoin(b.agg(F.count("*").alias("n_out")))  # one row
        one = one.select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n_in", "n_out")
        out = one if out is None else out.unionByName(one)
    pct = F.when(F.col("n_in") == 0, 100.0).otherwise(F.round(100.0 * F.col("n_out") / F.nullif(F.col("n_in"), F.lit(0)), 2))
    return out.withColumn("removed", F.col("n_in") - F.col("n_out")).withColumn("retention_pct", pct)


def size_reduction(files: DataFrame) -> DataFrame:
    """1 - characters of Markdown over bytes of PDF."""
    return files.agg(F.round(F.lit(1.0) - F.try_divide(F.sum("md_chars").cast("double"), F.sum("pdf_bytes")), 4).alias("reduction"))


def checkpoint_state(events: DataFrame, planned: DataFrame) -> DataFrame:
    """Resumable operation: planned (operation_id, item_key) and events (operation_id, item_key, ok, at) -> the counts
    and the state of each operation; an item's last event counts."""
    last = latest(events, ["operation_id", "item_key"], "at")
    rows = planned.join(last.select("operation_id", "item_key", "ok"), ["operation_id", "item_key"], "left")
    out = rows.groupBy("operation_id").agg(
        F.count("*").alias("total_items"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("pending")
    )
    return out.withColumn("state", F.when(F.col("pending") == 0, "completed").otherwise("active"))


def write_if_absent(df: DataFrame, path: str, policy: str = "skip") -> None:
    """skip leaves an existing table; timestamp writes beside it; anything else overwrites."""
    if policy == "timestamp":
        from datetime import datetime

        df.write.parquet(f"{path}_{datetime.now():%Y%m%d_%H%M%S}")
    else:
        df.write.mode("ignore" if policy == "skip" else "overwrite").parquet(path)


def number_rows(df: DataFrame, name: str, *order: str, start: int = 0) -> DataFrame:
    """Contiguous numbers from start in a total order: places of a prefix scan, so values with one prefix or one first
    column spread over tasks."""
    return numbered(df, list(order), name).withColumn(name, F.col(name) + (start - 1))
