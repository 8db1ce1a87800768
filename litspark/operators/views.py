"""Views of result tables: filters that all may be left out, an order and a number of rows to show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a view may show, besides everything.
SHOWN = (25, 50, 100, 200, 500)


def view(
    df: DataFrame, article=None, min_score: float | None = None, status: str | None = None, model: str | None = None, evidence: bool | None = None,
    score: str = "semantic_score", ties: tuple = ("article_id", "paragraph_id"), show: int | None = 50,
) -> DataFrame:
    """Rows of one article, with a score (null: 0) of at least min_score, of a status or model, with or without valid
    evidence; by score descending, where there is one, and the first ``show`` of them, or all with None.

    The first rows are a bounded top-k, so a view of a large table sorts nothing whole."""
    if show is not None and show not in SHOWN:
        raise ValueError(f"a view shows one of {SHOWN} rows, or all")
    for name, value in (("article_id", article), ("status", status), ("llm_model", model), ("evidence_valid", evidence)):
        if value is not None:
            df = df.filter(F.coalesce(F.col(name) == value, F.lit(False)))
    has_score = score in df.columns
    if min_score is not None:
        df = df.filter(F.coalesce(F.col(score), F.lit(0.0)) >= min_score)
    order = [F.coalesce(F.col(score), F.lit(0.0)).desc()] if has_score else []
    df = df.orderBy(*order, *(t for t in ties if t in df.columns)) if show is not None or has_score else df
    return df if show is None else df.limit(show)


def choices(df: DataFrame, column: str, most: int = 1000) -> list:
    """The values that a view may be filtered by, sorted; more than ``most`` are an error."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values of {column}")
    return [r[0] for r in rows]
