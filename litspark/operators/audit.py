"""Versions of a keyed table with a log of what changed in each: data, changes and then a numbered manifest are written, so
a version and its log appear together or not at all, and no reader meets half of either."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists
from ..sources.writers import save_manifest


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op (insert, update, delete), before, after (structs of the other columns; null where there is no row): the keyed
    difference of two tables with the same columns, whose keys are unique.  Null keys match null keys."""
    values = [c for c in new.columns if c not in keys]
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in keys), F.struct(*values).alias(name))
    a, b = side(old.select(*new.columns), "before"), side(new, "after")
    on = [F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")) for c in keys]
    rows = a.join(b, on, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    key = lambda c: F.when(F.col("after").isNull(), F.col(f"before_{c}")).otherwise(F.col(f"after_{c}")).alias(c)
    return rows.select(*map(key, keys), op.alias("op"), "before", "after")


def versions(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of the whole versions, oldest first."""
    import json

    if not path_exists(spark, path):
        return []
    try:
        rows = spark.read.text(f"{path}/manifest-*").collect()  # one row a version
    except AnalysisException:
        return []
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the newest by default."""
    found = [m for m in versions(spark, path) if version is None or m["version"] == version]
    if not found:
        raise FileNotFoundError(f"{path}: no such version")
    return spark.read.parquet(f"{path}/{found[-1]['data']}")


def save(table: DataFrame, path: str, keys: list[str], author: str, at: str, action: str = "save") -> dict:
    """Write the table as the next version with the changes from the last; returns the manifest, with the changes counted
    by kind.  Repeated keys are an error; so is another writer that was first."""
    spark = table.sparkSession
    if table.groupBy(*keys).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"rows repeat {', '.join(keys)}")
    have = versions(spark, path)
    version = have[-1]["version"] + 1 if have else 1
    old = current(spark, path) if have else table.limit(0)
    data, log, manifest = (f"{name}-{version:06d}" for name in ("data", "changes", "manifest"))
    if path_exists(spark, f"{path}/{manifest}"):
        raise FileExistsError(f"{path}: version {version} was written by another")
    table.write.mode("overwrite").parquet(f"{path}/{data}")  # of an attempt that left no manifest
    written = spark.read.parquet(f"{path}/{data}")
    about = {"version": F.lit(version), "author": F.lit(author), "at": F.lit(at).cast("timestamp"), "action": F.lit(action)}
    changes(old, written, keys).withColumns(about).write.mode("overwrite").parquet(f"{path}/{log}")
    counts = {r.op: r["count"] for r in spark.read.parquet(f"{path}/{log}").groupBy("op").count().collect()}  # three kinds
    content = {"version": version, "data": data, "changes": log, "keys": keys, "author": author, "at": at, "action": action, "counts": counts}
    save_manifest(spark, f"{path}/{manifest}", content)
    return content


def merge(rows: DataFrame, path: str, keys: list[str], author: str, at: str, action: str = "import") -> dict:
    """Save the newest version with these rows inserted or in place of those with their keys."""
    from .corpus import upsert

    spark = rows.sparkSession
    have = versions(spark, path)
    return save(upsert(current(spark, path), rows, *keys) if have else rows, path, keys, author, at, action)


def audit_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All changes of the whole versions up to one: keys, op, before, after, version, author, at, action."""
    parts = [f"{path}/{m['changes']}" for m in versions(spark, path) if upto is None or m["version"] <= upto]
    if not parts:
        raise FileNotFoundError(f"{path}: no versions")
    return spark.read.parquet(*parts)


def replay(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The table as the log alone gives it: the last change of each key, without deleted ones."""
    keys = versions(spark, path)[0]["keys"]
    last = audit_log(spark, path, upto).groupBy(*keys).agg(F.max_by(F.struct("op", "after"), "version").alias("_c"))
    return last.filter("_c.op <> 'delete'").select(*keys, "_c.after.*")
