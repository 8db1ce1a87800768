"""Anchors of a search as a small table: entry, adding, removing, and what is saved of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pos int, anchor_id string, text string, description string, weight double"


def parse(entries: DataFrame, entry: str = "entry", order: str | None = None, sep: str = ";") -> DataFrame:
    """Anchors of typed entries: cut at the separator, trimmed, blank ones left out, numbered Q1.. over all entries in
    their order (of one row each form; at most a search's MAX_ANCHORS, so one task numbers them)."""
    from .scan import numbered

    keys = [order] if order else [entry]
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(entry), F.lit("")), f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")
    rows = entries.select(*keys, F.posexplode(parts).alias("_at", "text"))
    out = numbered(rows, [*keys, "_at"], "pos").withColumn("pos", F.col("pos").cast("int"))
    return out.select("pos", F.concat(F.lit("Q"), F.col("pos")).alias("anchor_id"), "text", F.lit("").alias("description"), F.lit(1.0).alias("weight"))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Anchors of saved dictionaries (text, description, weight), numbered in their order."""
    data = [(i, f"Q{i}", str(r.get("text", "")), str(r.get("description", "")), float(r.get("weight", 1.0))) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, SCHEMA)


def to_rows(anchors: DataFrame) -> list[dict]:
    from ..functions.vectors import collect_anchors

    return [{"id": r.anchor_id, "text": r.text, "description": r.description, "weight": r.weight} for r in collect_anchors(anchors)]


def _again(anchors: DataFrame) -> DataFrame:
    from .scan import numbered

    out = numbered(anchors.withColumnRenamed("pos", "_pos"), ["_pos"], "pos").withColumn("pos", F.col("pos").cast("int"))
    return out.withColumn("anchor_id", F.concat(F.lit("Q"), F.col("pos"))).select("pos", "anchor_id", "text", "description", "weight")


def add(anchors: DataFrame, text: str, description: str = "", weight: float = 1.0) -> DataFrame:
    """One more anchor, the last."""
    pos = anchors.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("m")).first().m + 1
    return anchors.unionByName(anchors.sparkSession.createDataFrame([(pos, f"Q{pos}", text, description, float(weight))], SCHEMA))


def remove(anchors: DataFrame, anchor_id: str) -> DataFrame:
    """Without one anchor; those behind it move up and are numbered anew.  An unknown id removes nothing."""
    return _again(anchors.filter(F.col("anchor_id") != anchor_id))
