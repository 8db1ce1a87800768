"""Ranks and top rows without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import numbered


def global_rank(df: DataFrame, score: str, *ties: str, name: str = "rank") -> DataFrame:
    """Rank 1..n by score descending (null last), ties by the columns given: places of a prefix scan, so equal scores spread
    over tasks."""
    return numbered(df, [F.col(score).desc_nulls_last(), *ties], name)


def hash_order(key, seed: int = 42) -> Column:
    """A fixed shuffle: the order of md5(seed|key)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, by an aggregate instead of a window: no key gathers its rows."""
    value = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_row")).select("_row.*")
