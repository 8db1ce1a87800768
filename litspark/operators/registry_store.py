"""A registry of articles laid out for look-ups: by content hash and by file name.

Rows lie in buckets of their key, sorted by it, with Parquet Bloom filters on it: a look-up opens the files of its buckets
(partition pruning) and skips row groups whose range, dictionary or Bloom filter excludes the key.  The names are a second,
narrow table of the same kind.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MAX_KEYS = 10  # of a point look-up: as many as Spark pushes to the scan one by one; more are a join
KEYS = {"pdf_sha256": "by_hash", "source_filename": "by_name"}


def bucket_of(key: str, buckets: int) -> int:
    return int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % buckets


def bucket(key: str, buckets: int) -> Column:
    return (F.conv(F.substring(F.sha2(F.col(key), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int, expected: int) -> None:
    laid = rows.filter(F.col(key).isNotNull()).withColumn("bucket", bucket(key, buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    out = laid.write.mode("overwrite").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true")
    out.option(f"parquet.bloom.filter.expected.ndv#{key}", max(1000, expected)).parquet(f"{path}/{KEYS[key]}")


def save(registry: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """registry (article_id, pdf_sha256, source_filename and whatever else); rows without hash or name are found by the
    other only."""
    if registry.columns.count("bucket"):
        raise ValueError("bucket is the layout's own column")
    expected = registry.count() // buckets
    _write(registry, path, "pdf_sha256", buckets, expected)
    _write(registry, path, "source_filename", buckets, expected)


def find(spark: SparkSession, path: str, key: str, values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows whose key (pdf_sha256 or source_filename) is one of a few values."""
    if len(values) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys; join them with find_all")
    rows = spark.read.parquet(f"{path}/{KEYS[key]}")
    places = sorted({bucket_of(v, buckets) for v in values})
    return rows.filter(F.col("bucket").isin(places) & F.col(key).isin(list(values))).drop("bucket")


def find_all(keys: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose key is in a table of any size: a join by bucket and key, which prunes buckets while it runs."""
    asked = keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("bucket", bucket(key, buckets))
    return keys.sparkSession.read.parquet(f"{path}/{KEYS[key]}").join(asked, ["bucket", key], "left_semi").drop("bucket")
