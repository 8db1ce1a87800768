"""An inverted-file index: vectors stored by the nearest of some coarse centroids and searched by probing a few cells.

Cells are directories of one Parquet table, so a search reads the probed cells and nothing else.  Two metrics: ``cosine``
(unit vectors, inner product; greatest first) and ``l2`` (Euclidean distance; least first).  Both use Euclidean distances to
centroids, of unit vectors for cosine, so that a cell's radius bounds how near any of its vectors can be: an exact search
probes a few cells and then only those that can still hold a better vector.

Rows with a null vector, one of another length or with a component that is not finite are not indexed.  Zero vectors have a
cosine of 0.  Scores are rounded to PLACES and ties go to the smaller id, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .index import _write_version, load, versions
from .search import PLACES
from ..sources.readers import path_exists

MAX_CELLS = 1 << 16  # centroids are collected
MAX_QUERIES = 1000  # queries of one search are collected, too; more are searched in blocks
PER_CELL = 64  # rows a cell that the centroids are fitted on
METRICS = ("cosine", "l2")
FOUND = "query_id long, id long, cell int, score double"


def _space(x, metric: str) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return unit(x) if metric == "cosine" else x


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0))


def usable(rows: DataFrame, size: int, embedding: str = "embedding") -> DataFrame:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(e.isNotNull() & (F.size(e) == size) & F.coalesce(finite, F.lit(False)))


# ---------------------------------------------------------------- building
def train(rows: DataFrame, id: str, cells: int, metric: str = "cosine", seed: int = 42) -> np.ndarray:
    """Centroids fitted on about PER_CELL rows a cell, chosen by a hash of the id; at most ``cells``, as equal vectors share one."""
    n = rows.count()
    share = min(1.0, PER_CELL * cells / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))
    to_space = F.pandas_udf(lambda v: pd.Series(list(_space(np.stack(v.to_numpy()), metric))), "array<double>")
    points = sample.select(array_to_vector(to_space(F.col("embedding"))).alias("features"))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=15, initSteps=3).fit(points)
    return np.array(model.clusterCenters())


def assign(rows: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """rows with cell (the nearest centroid) and radius (its distance): one matrix product a batch."""

    @F.pandas_udf("cell int, radius double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "radius": pd.Series([], dtype="float64")})
        d = _distances(_space(np.stack(v.to_numpy()), metric), centroids)
        at = d.argmin(1)
        return pd.DataFrame({"cell": at.astype(np.int32), "radius": d[np.arange(len(d)), at]})

    return rows.withColumn("_near", nearest(F.col("embedding"))).select(*rows.columns, F.col("_near.cell").alias("cell"), F.col("_near.radius").alias("radius"))


def build(rows: DataFrame, path: str, id: str = "faiss_id", metric: str = "cosine", cells: int | None = None, config: dict | None = None, seed: int = 42) -> dict:
    """Write rows (id, embedding and whatever else) as the next version of an index at path; returns its manifest.

    Without a number of cells there are as many as the square root of the rows.  Rebalancing spreads a cell with a large
    share of the rows over files and puts small cells into tasks together."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark, first = rows.sparkSession, rows.filter("embedding is not null").select(F.size("embedding").alias("n")).first()
    if first is None:
        raise ValueError("there are no vectors to index")
    rows = usable(rows, first.n)
    cells = min(MAX_CELLS, cells or math.isqrt(max(0, rows.count() - 1)) + 1)
    centroids = train(rows, id, cells, metric, seed)
    have = versions(spark, path) if path_exists(spark, path) else []
    version = have[-1]["version"] + 1 if have else 1
    part, heads = f"data-{version:06d}", f"cells-{version:06d}"
    assign(rows, centroids, metric).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{part}")
    sizes = spark.read.parquet(f"{path}/{part}").groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"))
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    centres.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/{heads}")
    return _write_version(spark, path, version, [part], {**(config or {}), "kind": "ivf", "metric": metric, "id": id, "cells": heads, "dimension": first.n})


class InvertedFile:
    """The newest version of an index at path."""

    def __init__(self, spark: SparkSession, path: str, check: bool = False):
        self.rows, self.manifest = load(spark, path, check)
        config = self.manifest["config"]
        if config.get("kind") != "ivf":
            raise ValueError("the index has no cells")
        self.spark, self.metric, self.id, self.dimension = spark, config["metric"], config["id"], config["dimension"]
        heads = spark.read.parquet(f"{path}/{config['cells']}").orderBy("cell").collect()  # at most MAX_CELLS, none is empty
        self.cells = np.array([r.cell for r in heads])
        self.centroids = np.array([r.centroid for r in heads])
        self.radius = np.array([r.radius for r in heads])
        self.sizes = np.array([r.n for r in heads])

    # ------------------------------------------------------------ probing
    def _collect(self, queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = usable(queries, self.dimension).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
        rows = sorted(found.collect(), key=lambda r: r.query_id)  # a block of queries
        return np.array([r.query_id for r in rows], np.int64), _space([r.embedding for r in rows], self.metric).reshape(-1, self.dimension)

    def _scan(self, ids: np.ndarray, vectors: np.ndarray, wanted: list[np.ndarray], k: int, rows: DataFrame, low: float, high: float) -> DataFrame:
        """The k best of every query in the cells (places in self.cells) that it wants."""
        by_cell: dict[int, list[int]] = defaultdict(list)
        for q, places in enumerate(wanted):
            for p in places:
                by_cell[int(self.cells[p])].append(q)
        asked = {c: np.array(q) for c, q in by_cell.items()}
        cosine, metric, id = self.metric == "cosine", self.metric, self.id

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                key, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = _space(np.stack(b.column(2).to_numpy(zero_copy_only=False)), metric)
                order = np.lexsort((key, cell))
                starts = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
                for i, j in zip(starts, np.append(starts[1:], len(order))):
                    at = order[i:j]
                    q = asked[int(cell[at[0]])]
                    s = np.round(x[at] @ vectors[q].T if cosine else _distances(x[at], vectors[q]), PLACES)
                    cost = np.where((s >= low) & (s <= high), -s if cosine else s, np.inf)
                    top = np.argsort(cost, axis=0, kind="stable")[:k]
                    good = np.isfinite(np.take_along_axis(cost, top, 0))
                    col = np.broadcast_to(np.arange(len(q)), top.shape)[good]
                    top = top[good]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[q[col]]), pa.array(key[at[top]].astype(np.int64)), pa.array(np.full(len(top), cell[at[0]], np.int32)), pa.array(s[top, col])], names=["query_id", "id", "cell", "score"]
                    )

        pruned = rows.filter(F.col("cell").isin([int(c) for c in asked])).select(F.col(id).cast("long").alias("id"), "cell", "embedding")
        return pruned.mapInArrow(run, FOUND)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        score = F.desc("score") if self.metric == "cosine" else F.col("score")
        order = Window.partitionBy("query_id").orderBy(score, "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def search(
        self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, classes: list | None = None,
        min_score: float = -math.inf, max_score: float = math.inf,
    ) -> DataFrame:
        """queries (query_id, embedding) -> query_id, rank from 1, id, cell, score: the k best rows that pass the filters.

        Each query probes its nearest cells; one that finds fewer than k rows probes twice as many until it has them or
        has seen all cells, so filters never shorten a result.  exact: then also the cells whose radius lets them hold a row
        as good as the k-th found.  classes: numbers or class_<n>, all required; unknown ones are ignored.  Queries that
        repeat an id count once (the least vector); those without a usable vector find nothing."""
        rows = self.rows
        for c in classes or ():
            name = c if str(c).startswith("class_") else f"class_{c}"
            rows = rows.filter(F.col(name)) if name in rows.columns else rows
        blocks = -(-queries.select("query_id").distinct().count() // MAX_QUERIES)
        out = None
        for i in range(max(1, blocks)):
            block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
            one = self._search_block(*self._collect(block), k, probes, exact, rows, min_score, max_score)
            out = one if out is None else out.unionByName(one)
        return out.select("query_id", "rank", "id", "cell", "score")

    def _search_block(self, ids, vectors, k, probes, exact, rows, low, high) -> DataFrame:
        if not len(ids):
            return self._best(self.spark.createDataFrame([], FOUND), k)
        d = _distances(vectors, self.centroids)
        order = np.argsort(d, axis=1, kind="stable")
        reach = np.full(len(ids), min(max(1, probes), len(self.cells)))
        short = np.arange(len(ids))
        wanted = [order[q, : reach[q]] for q in range(len(ids))]
        worst = np.full(len(ids), np.inf)
        # what a pass without filters must find is known from the sizes of the cells
        if rows is not self.rows or low > -math.inf or high < math.inf or exact or (np.array([self.sizes[w].sum() for w in wanted]) < k).any():
            while True:
                found = self._best(self._scan(ids[short], vectors[short], [wanted[q] for q in short], k, rows, low, high), k).groupBy("query_id")
                seen = {r.query_id: (r.n, r.worst) for r in found.agg(F.count("*").alias("n"), (F.min if self.metric == "cosine" else F.max)("score").alias("worst")).collect()}
                for q in short:
                    n, w = seen.get(int(ids[q]), (0, None))
                    worst[q] = w if n >= k else np.inf
                short = np.array([q for q in short if seen.get(int(ids[q]), (0, None))[0] < k and reach[q] < len(self.cells)], int)
                if not len(short):
                    break
                reach[short] = np.minimum(2 * reach[short], len(self.cells))
                for q in short:
                    wanted[q] = order[q, : reach[q]]
        if exact:
            for q in np.flatnonzero(np.isfinite(worst)):
                # scores are rounded; of unit vectors, the distance follows from the cosine
                far = math.sqrt(max(0.0, 2 - 2 * (worst[q] - 10.0**-PLACES))) if self.metric == "cosine" else worst[q] + 10.0**-PLACES
                wanted[q] = np.union1d(wanted[q], np.flatnonzero(d[q] - self.radius <= far + 1e-6))
            for q in np.flatnonzero(~np.isfinite(worst)):
                wanted[q] = order[q]
        return self._best(self._scan(ids, vectors, wanted, k, rows, low, high), k)

    # ------------------------------------------------------------ recall
    def tune(self, queries: DataFrame, k: int = 10, target: float = 0.95) -> tuple[int, float]:
        """The fewest probes whose recall of these queries' exact k nearest reaches the target, and that recall.  One exact
        search tells how many cells a query must probe for each of its neighbours."""
        ids, vectors = self._collect(queries)
        order = np.argsort(_distances(vectors, self.centroids), axis=1, kind="stable")
        place = {(int(i), int(self.cells[c])): n + 1 for q, i in enumerate(ids) for n, c in enumerate(order[q])}
        need = np.sort([place[r.query_id, r.cell] for r in self.search(queries, k, exact=True).select("query_id", "cell").collect()])
        if not len(need):
            return 1, 1.0
        probes = int(need[min(len(need), math.ceil(target * len(need))) - 1])
        return probes, float((need <= probes).mean())


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results (query_id, id) that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"]).count()
    return hits / max(1, exact.count())
