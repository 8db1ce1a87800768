"""Running sums and places over one order that no task holds whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..sources.shared import saved


def running(values: np.ndarray, first: np.ndarray, carry: int) -> np.ndarray:
    """Cumulative sums that start anew where first is set; carry goes to the rows before the first such place."""
    total = np.cumsum(values)
    starts = np.flatnonzero(first)
    base = np.full(len(values), -carry, np.int64)
    if len(starts):
        before = total[starts] - values[starts]
        base[starts[0] :] = np.repeat(before, np.diff(np.append(starts, len(values))))
    return total - base


def prefix_scan(df: DataFrame, order: list[Column | str], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """df with inclusive running sums of whole numbers in the order given, from the start of each group of ``by``.

    Rows are cut into range partitions at sampled bounds of (by, order), so a group, or rows whose first order columns are
    equal, spread over as many tasks as they need; only rows equal in all of them stay together.  Each partition is sorted
    and summed alone and the table is written once, as sampled bounds may differ from run to run.  What earlier partitions
    hold of the group that a partition begins with comes from one row a partition and is added back by a broadcast join.

    Nulls sort as the order says (ascending: first); a null value counts as 0; an empty table stays empty."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    rows = df.select("*", *(F.coalesce(e.cast("long"), F.lit(0).cast("long")).alias(s) for s, e in sums.items()), F.xxhash64(F.lit(0), *by).alias("_group"))
    schema = StructType(rows.schema.fields).add("_part", IntegerType()).add("_place", LongType())
    names = list(sums)

    def add(batches):
        part, place, last, carry = TaskContext.get().partitionId(), 0, None, dict.fromkeys(names, 0)
        for b in batches:
            if not b.num_rows:
                continue
            group = b.column(b.schema.get_field_index("_group")).to_numpy()
            first = np.append(True if last is None else group[0] != last, group[1:] != group[:-1])
            for s in names:
                i = b.schema.get_field_index(s)
                out = running(b.column(i).to_numpy(), first, carry[s])
                carry[s], b = int(out[-1]), b.set_column(i, b.schema.field(i), pa.array(out))
            last = group[-1]
            b = b.append_column("_part", pa.array(np.full(b.num_rows, part, np.int32)))
            yield b.append_column("_place", pa.array(np.arange(place, place + b.num_rows)))
            place += b.num_rows

    table = saved(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(add, schema), "scan")
    ends = table.groupBy("_part").agg(F.min_by("_group", "_place").alias("first"), F.max_by(F.struct("_group", *names), "_place").alias("last"))
    offsets, group, total = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r._part):  # one row a partition
        had = total if group == r.first else dict.fromkeys(names, 0)
        offsets.append((r._part, r.first, *had.values()))
        group, one = r.last._group, r.first == r.last._group
        total = {s: r.last[s] + (had[s] if one else 0) for s in names}
    known = spark.createDataFrame(offsets, "_part int, _group long, " + ", ".join(f"`_before_{s}` long" for s in names))
    joined = table.join(F.broadcast(known), ["_part", "_group"], "left")  # at most one row a partition
    whole = {s: F.col(s) + F.coalesce(F.col(f"_before_{s}"), F.lit(0)) for s in names}
    return joined.select(*(F.col(c) for c in df.columns), *(e.alias(s) for s, e in whole.items()))


def numbered(df: DataFrame, order: list[Column | str], name: str, by: list[str] = ()) -> DataFrame:
    """df with the place 1..n of each row in the order given (of its group); rows equal in all of it in any order."""
    return prefix_scan(df, order, {name: F.lit(1)}, by)
