"""Connected components of a distributed edge list: alternating large and small stars, then one bounded union-find."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

LOCAL = 100_000  # edges that one task finishes at most; a longer list is first shortened by star rounds


def _state(df: DataFrame):
    r = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r.n, r.x


def _union(batches):
    """Edges -> node, root of every node that is not a root."""
    parent: dict[int, int] = {}

    def find(x):
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(u), find(v)
            parent[max(x, y)] = min(x, y)
    nodes = [n for n in parent if find(n) != n]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, root: the smallest node reachable, for every node that is not a root itself.

    Minima are aggregated before each shuffle and neighbours are joined back by key, so a node with very many
    neighbours is never gathered in one place.  Every round is a table in the shared folder."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    state = _state(e)
    while state[0] > LOCAL:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(hang.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e, before = small, state
        state = _state(e)
        if state == before:  # every node hangs on its root
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._litspark_path = e._litspark_path  # discard() deletes it
            return out
    out = materialize(e.coalesce(1).mapInArrow(_union, "node long, root long"), "labels")
    discard(e)
    return out
