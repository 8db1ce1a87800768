"""Label rules: class 0 stands alone; any of 1 to 5 displaces it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The active classes 1 to 5, and class 0.
CLASSES = ("definition", "determinant", "type_dimension", "causal_relation", "property")
NOT_RELEVANT = "not_relevant"


def sanitize(labels) -> Column:
    """Sorted distinct classes 1..5 if any, else [0] if 0 was given, else []."""
    active = F.array_sort(F.array_intersect(F.array_distinct(labels), F.array(*map(F.lit, range(1, 6)))))
    return F.when(F.size(active) > 0, active).when(F.array_contains(labels, 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def to_vector(labels) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda c: F.array_contains(sanitize(labels), c).cast("int"))


def from_vector(vector) -> Column:
    """Classes of the ones; [0] for the zero vector."""
    on = F.filter(F.transform(vector, lambda x, i: F.when(x == 1, i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(on) > 0, on).otherwise(F.array(F.lit(0)))


def from_flags(*flags) -> Column:
    """Booleans of classes 0..5 to a label array; class 0 short-circuits."""
    zero, *rest = flags
    on = F.filter(F.array(*(F.when(f, F.lit(i + 1)) for i, f in enumerate(rest))), lambda x: x.isNotNull())
    return F.when(zero, F.array(F.lit(0))).otherwise(on)


def class_names(labels) -> Column:
    names = F.array(F.lit(NOT_RELEVANT), *map(F.lit, CLASSES))
    return F.transform(labels, lambda c: F.get(names, c))
