"""Approximate nearest neighbours by stable projections.

Vectors are projected on M Gaussian directions (2-stable, so the projected distance of two vectors is their distance
times a chi variable with M degrees of freedom).  A kd-tree over the projected space, whose upper part is fitted on a
bounded sample and whose lower part is built from all rows of a cell, indexes every row.  A query asks for its projected
neighbours one after the other, verifies them with exact distances, and stops when the chi-square test holds: a vector no
farther than the current k-th would by now have come with probability CONFIDENCE or more.

Rows are dealt to the cells of the upper tree once and not copied.  A query first searches its own cell; its k-th distance
there, times the test's quantile, is a radius, and it then visits the cells that the radius reaches and no others.  Cells
and the queries that visit them meet by a shuffle; a task holds one cell's rows and streams queries past them.  A cell of
many more rows than CELL_ROWS is dealt over slices with a tree each.

Only vectors of one length are compared.  Vectors that are null, zero, or hold null or non-finite components take no
part.  Of equal vectors only the k + 1 smallest ids can be among any query's k nearest, and only those are searched, so a
vector that a third of all rows share is a few rows.  Results: ranks from 1, nearest first, ties to the smaller vec_id;
fewer rows if there are fewer candidates; rows repeating a vec_id count once, with their least vector; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, n_parts, record, trim

K = 10
M = 24  # projected dimensions; even, so that the chi-square distribution has a closed form
CONFIDENCE = 0.88
CELL_ROWS = 16_384
SAMPLE = 1 << 18  # rows at most that the upper tree is fitted on: 32 a cell, so 8,192 cells at most, then slices
PER_CELL = 32
LEAF = 64
STEP = 256  # projected neighbours verified between two tests
SEED = 20240117


def chi_square_cdf(x: float, m: int = M) -> float:
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def chi_square_quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(dim: int) -> np.ndarray:
    """The projection of vectors of one length, the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, M))


# ---------------------------------------------------------------- upper tree
class Cells:
    """Splits of the projected space: node i is (axis, value, children), a leaf a cell's number."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple] = []
        self.cells = 0
        self._grow(points, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        axis = int(np.argmax(spread))
        if cells < 2 or len(points) < 2 or spread[axis] == 0:
            self.nodes.append((-1, self.cells, 0, 0))
            self.cells += 1
            return me
        value = float(np.median(points[:, axis]))
        left = points[:, axis] < value
        if not left.any():  # the median is the least value
            value = float(np.min(points[points[:, axis] > value, axis]))
            left = points[:, axis] < value
        self.nodes.append(None)
        a = self._grow(points[left], cells // 2)
        b = self._grow(points[~left], cells - cells // 2)
        self.nodes[me] = (axis, value, a, b)
        return me

    def locate(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            axis, value, a, b = self.nodes[node]
            if axis < 0:
                out[at] = value
            elif len(at):
                left = points[at, axis] < value
                todo += [(a, at[left]), (b, at[~left])]
        return out

    def reach(self, point: np.ndarray, radius2: float) -> list[int]:
        """Cells within a squared projected distance of a point."""
        out, todo = [], [(0, 0.0, {})]
        while todo:
            node, d, gaps = todo.pop()
            axis, value, a, b = self.nodes[node]
            if axis < 0:
                out.append(value)
                continue
            gap = float(point[axis]) - value
            near, far = (a, b) if gap < 0 else (b, a)
            todo.append((near, d, gaps))
            beyond = d - gaps.get(axis, 0.0) + gap * gap
            if beyond <= radius2:
                todo.append((far, beyond, {**gaps, axis: gap * gap}))
        return out


# ---------------------------------------------------------------- a cell's tree
class KdTree:
    """Projected points with the bounding boxes of all nodes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.kids, self.members, lo, hi = points, [], [], [], []
        todo = [(np.arange(len(points)), None)]
        while todo:
            at, parent = todo.pop()
            me, part = len(self.kids), points[at]
            lo.append(part.min(0))
            hi.append(part.max(0))
            self.kids.append([])
            self.members.append(at)
            if parent is not None:
                self.kids[parent].append(me)
            axis = int(np.argmax(hi[-1] - lo[-1]))
            if len(at) > leaf and hi[-1][axis] > lo[-1][axis]:
                order = np.argpartition(part[:, axis], len(at) // 2)
                self.members[me] = None
                todo += [(at[order[: len(at) // 2]], me), (at[order[len(at) // 2 :]], me)]
        self.lo, self.hi = np.stack(lo), np.stack(hi)

    def neighbours(self, q: np.ndarray):
        """Groups of points and their squared projected distances, nearest first: best-first walk; a point comes when no
        node that is left can hold a nearer one."""
        heap, parts, least = [(0.0, 0)], [], math.inf  # parts: points of opened leaves that haven't come yet
        while heap or parts:
            while heap and heap[0][0] <= least:
                _, node = heapq.heappop(heap)
                at = self.members[node]
                if at is None:
                    kids = self.kids[node]
                    gap = np.maximum(np.maximum(self.lo[kids] - q, q - self.hi[kids]), 0.0)
                    for d, kid in zip((gap * gap).sum(1).tolist(), kids):
                        heapq.heappush(heap, (d, kid))
                else:
                    diff = self.points[at] - q
                    parts.append(((diff * diff).sum(1), at))
                    least = min(least, float(parts[-1][0].min()))
            d, i = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(d, kind="stable")
            d, i = d[order], i[order]
            ready = int(np.searchsorted(d, heap[0][0], side="left")) if heap else len(d)
            for start in range(0, ready, STEP):
                yield i[start : min(start + STEP, ready)], d[start : min(start + STEP, ready)]
            parts = [(d[ready:], i[ready:])] if ready < len(d) else []
            least = float(d[ready]) if ready < len(d) else math.inf


class Cell:
    """A cell's rows, ready for queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.gauss = directions(vectors.shape[1])
        self.tree = KdTree(vectors @ self.gauss)

    def search(self, query_id: int, q: np.ndarray, k: int, limit: float, bound2: float = math.inf):
        """ids and squared distances of the k nearest found, and how many were verified; bound2: the square of a distance
        within which k others are known."""
        best_d, best_i, verified, seen = np.empty(0), np.empty(0, np.int64), 0, 0.0
        for at, d in self.tree.neighbours(q @ self.gauss):
            worst = min(bound2, best_d[-1] if len(best_d) == k else math.inf)
            if d[0] > limit * worst:
                break  # the test: P(chi-square <= d / d_k ** 2) >= confidence
            at = at[(d <= limit * worst) & (self.ids[at] != query_id)]
            diff = self.vectors[at] - q
            verified += len(at)
            best_d, best_i = np.concatenate((best_d, (diff * diff).sum(1))), np.concatenate((best_i, self.ids[at]))
            order = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[order], best_i[order]
        return best_i, best_d, verified


# ---------------------------------------------------------------- Spark
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])
FOUND_DDL = "query_id long, vec_id long, score double, verified long"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v, dim of the vectors that take part; of rows that repeat a vec_id the least vector."""
    v = rows.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    v = v.filter(whole & F.exists("v", lambda x: x != 0.0))
    if not v.select("vec_id").groupBy("vec_id").count().filter("count > 1").isEmpty():  # ids alone are moved
        v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    return v.withColumn("dim", F.size("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_dim(batches):
    """(dim, other columns, matrix) of batches whose columns begin with dim and end with v."""
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == dim)) if (dims != dim).any() else b
            yield dim, part, _matrix(part.column(part.num_columns - 1))


def fit(rows: DataFrame) -> dict[int, tuple[Cells, int]]:
    """By length of vectors: the upper tree and the number of slices of a cell."""
    out = {}
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # lengths of vectors
    total = sum(sizes.values())
    share = min(1.0, SAMPLE / max(1, total), PER_CELL / CELL_ROWS * 4)
    small = [d for d, n in sizes.items() if n <= CELL_ROWS]
    picked = rows.filter(~F.col("dim").isin(small) & (F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 24)) < int(share * (1 << 24))))

    def project(batches):
        for dim, part, x in _by_dim(batches):
            y = x @ directions(dim)
            yield record(pa.schema([("dim", pa.int32()), ("y", pa.list_(pa.float64()))]), pa.array(np.full(len(y), dim, np.int32)), pa.array(list(y), pa.list_(pa.float64())))

    points: dict[int, list] = {}
    for r in picked.select("dim", "v").mapInArrow(project, "dim int, y array<double>").toLocalIterator():  # about SAMPLE rows at most
        points.setdefault(r.dim, []).append(r.y)
    for dim, n in sizes.items():
        y = np.array(points.get(dim, [])).reshape(-1, M)
        tree = Cells(y, max(1, min(-(-n // CELL_ROWS), len(y) // PER_CELL)))
        out[dim] = (tree, max(1, -(-n // (tree.cells * CELL_ROWS * 2))))
    return out


PLACED = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("slice", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("bound2", pa.float64())])


def _placed(rows: DataFrame, shared, kind: int, other: bool = False) -> DataFrame:
    """dim, cell, slice, kind, id, bound2, v.  kind 0: a row in its cell and slice; 1: a query in all slices of its own cell,
    or, other, of those besides that its bound reaches."""
    limit, vtype = chi_square_quantile(CONFIDENCE), rows.schema["v"].dataType

    def run(batches):
        for dim, part, x in _by_dim(batches):
            tree, slices = shared.value[dim]
            y, ids, bound2 = x @ directions(dim), part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            cells = tree.locate(y)
            at = np.arange(len(ids))
            if other:
                reached = [[c for c in tree.reach(p, limit * b) if c != own] for p, b, own in zip(y, bound2.tolist(), cells.tolist())]
                at = np.repeat(at, [len(r) for r in reached])
                cells = np.array([c for r in reached for c in r], np.int64)
            else:
                cells = cells[at]
            if kind:
                at, cells = np.repeat(at, slices), np.repeat(cells, slices)
                slot = np.tile(np.arange(slices), len(at) // slices)
            else:
                slot = ids % slices
            for i in range(0, len(at), 1024):
                take = at[i : i + 1024]
                cols = [np.full(len(take), dim, np.int32), cells[i : i + 1024], slot[i : i + 1024].astype(np.int32), np.full(len(take), kind, np.int32), ids[take], bound2[take]]
                v = part.column(part.num_columns - 1).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), v], names=[*PLACED.names, "v"])

    ddl = f"dim int, cell long, slice int, kind int, id long, bound2 double, v {vtype.simpleString()}"
    return rows.select("dim", F.col("vec_id").alias("id"), F.col("bound2") if "bound2" in rows.columns else F.lit(math.inf).alias("bound2"), "v").mapInArrow(run, ddl)


def _searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Placed rows and placed queries, met by cell and slice: what each query finds there."""
    limit = chi_square_quantile(CONFIDENCE)

    def run(batches):
        key, ids, vectors, cell = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            where = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            starts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1)))
            out = ([], [], [], [])
            for i, j in zip(starts.tolist(), np.append(starts[1:], len(where)).tolist()):
                if tuple(where[i, :3]) != key:
                    key, ids, vectors, cell = tuple(where[i, :3]), [], [], None
                x = _matrix(b.column(6).slice(i, j - i))
                if where[i, 3] == 0:
                    ids.append(b.column(4).slice(i, j - i).to_numpy())
                    vectors.append(x)
                    continue
                if cell is None and ids:
                    cell = Cell(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                if cell is not None:
                    for query, q, bound2 in zip(b.column(4).slice(i, j - i).to_pylist(), x, b.column(5).slice(i, j - i).to_pylist()):
                        found, d, verified = cell.search(query, q, k, limit, bound2)
                        out[0].append(np.full(len(found), query))
                        out[1].append(found)
                        out[2].append(np.sqrt(d))
                        out[3].append(np.full(len(found), verified))
            if out[0]:
                yield record(FOUND, *(np.concatenate(c) for c in out))
        trim()

    both = rows.unionByName(queries).repartition(n_parts(rows.sparkSession), "dim", "cell", "slice").sortWithinPartitions("dim", "cell", "slice", "kind")
    return both.mapInArrow(run, FOUND_DDL)


def nearest(rows: DataFrame, is_query=None, k: int = K) -> DataFrame:
    """rows (vec_id, embedding) -> query_id, rank, vec_id, score of the k nearest of each query row."""
    spark, rows = rows.sparkSession, usable(rows)
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    queries = rows.filter(is_query)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")  # limited in every task first
    shared = spark.sparkContext.broadcast(fit(rows))  # a few bytes a cell
    few = materialize(_placed(few, shared, 0), "placed")
    own = materialize(_searched(few, _placed(queries, shared, 1), k), "own-cell")
    bounds = own.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("worst"))
    bound2 = F.when(F.col("n") >= k, F.col("worst") * F.col("worst")).otherwise(F.lit(math.inf))
    asking = queries.join(bounds, queries.vec_id == bounds.query_id, "left").select("dim", "vec_id", F.coalesce(bound2, F.lit(math.inf)).alias("bound2"), "v")
    others = _searched(few, _placed(asking, shared, 1, other=True), k)
    found = own.unionByName(others).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    found = materialize(found, "found")
    discard(few, own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(rows: DataFrame, is_query=None, k: int = K) -> DataFrame:
    """Brute force in expressions, for measuring recall on small tables."""
    rows = usable(rows).withColumn("v", F.col("v").cast("array<double>"))
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    q = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim")
    d = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return q.join(rows, "dim").filter("query_id <> vec_id").select("query_id", "vec_id", d.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)
