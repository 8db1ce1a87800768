"""Vectors: cosine similarities with a few anchors, one matrix product per Arrow batch, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ANCHORS = 1000  # anchors are parameters of a search, collected to the driver; more is an error
BLOCK = 1 << 20  # numbers of a block of vectors or of its cosines: 8 MB


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    x = np.asarray(x, dtype=np.float64)
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def collect_anchors(anchors: DataFrame) -> list:
    """Rows (anchor_id, embedding, weight) in the order of pos."""
    rows = anchors.orderBy("pos").limit(MAX_ANCHORS + 1).collect()
    if len(rows) > MAX_ANCHORS:
        raise ValueError(f"more than {MAX_ANCHORS} anchors")
    return rows


def centroid(vectors: np.ndarray) -> np.ndarray:
    """Mean of unit vectors, renormalised."""
    return unit(unit(vectors).mean(0))


def cosines(v: pa.Array, anchors: np.ndarray) -> pa.Array:
    """Cosines of a list array's vectors with unit anchors; components that are null count as 0, a null vector has none."""
    there = np.asarray(v.is_valid())
    lengths = np.unique(np.asarray(pc.list_value_length(v.drop_null())))
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = unit(np.nan_to_num(flat).reshape(there.sum(), lengths[0] if len(lengths) else anchors.shape[1]))
    offsets = np.append(0, np.cumsum(there * len(anchors))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((x @ anchors.T).ravel()), mask=pa.array(~there))


def similarities(vector, matrix: np.ndarray) -> Column:
    """Cosines of a vector column with the rows of a matrix: array<double>; null for a null vector.

    Marked as not deterministic, although it is: else the optimiser copies it into every filter on what follows from it, and
    a task runs a Python worker and the product for each copy."""
    anchors = unit(matrix)
    rows = max(1, BLOCK // max(anchors.shape))

    @F.arrow_udf("array<double>")
    def product(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            for i in range(0, len(v), rows):
                yield cosines(v.slice(i, rows), anchors)

    return product.asNondeterministic()(vector)


def dot(a, b) -> Column:
    """Dot product in expressions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(v) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
