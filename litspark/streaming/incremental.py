"""Resumable, incremental stages as Structured Streaming over the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> int:
    """Run transform over the Parquet files of source that no earlier call has seen, and append the results; returns the
    rows now in the target.  The checkpoint remembers what is done, so an interrupted call goes on where it stopped."""
    rows = spark.readStream.schema(schema).parquet(source)
    q = transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
    q.awaitTermination()
    return spark.read.parquet(target).count()


def _pointers(spark: SparkSession, target: str) -> list[dict]:
    """The whole versions of an upserted table, oldest first."""
    try:
        rows = spark.read.text(f"{target}/pointer-*").collect()  # one row a version
    except AnalysisException:
        return []
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["epoch"])


def upsert_stream(spark: SparkSession, source: str, schema: str, keys: list[str], target: str, checkpoint: str) -> None:
    """Keep the newest row of each key: every micro-batch writes a new version of the table and then a pointer under a
    name of its own, which nothing overwrites, so readers, who take the last pointer, never see half a version; a replayed
    batch whose pointer is there does nothing.  Of a batch's rows of one key the greatest (by all columns) is kept."""
    from ..operators.corpus import upsert
    from ..sources.writers import save_manifest

    def merge(batch: DataFrame, epoch: int) -> None:
        have = _pointers(spark, target)
        if have and have[-1]["epoch"] >= epoch:
            return
        row = F.struct(*batch.columns)
        fresh = batch.groupBy(*keys).agg(F.max(row).alias("_r")).select("_r.*")
        out = upsert(spark.read.parquet(have[-1]["path"]), fresh, *keys) if have else fresh
        path = f"{target}/v{epoch}"
        out.write.mode("overwrite").parquet(path)  # of an attempt that left no pointer
        save_manifest(spark, f"{target}/pointer-{epoch:012d}", {"epoch": epoch, "path": path})

    rows = spark.readStream.schema(schema).parquet(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    found = _pointers(spark, target)
    if not found:
        raise FileNotFoundError(f"{target}: no version")
    return spark.read.parquet(found[-1]["path"])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operations per window and type, late events within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
