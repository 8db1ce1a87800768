"""Quality classifier by co-training on two views.

The text view sees hashed byte trigrams of the whole text; the metadata view sees language, source and the page's
layout (length, lines, line length).  Each view's logistic model first learns from the labelled rows and is calibrated on
held-out ones; then, round by round, each labels the documents of which its calibrated log-odds are surest, among all
without a label, for the other view, and both are fitted and calibrated again.  A round reads the documents twice: counts
by confidence give the thresholds that fill the quota, then the documents above them are written with the receiving
view's features; models are fitted by gradients summed on the executors.  What earlier rounds gave is found again from
their models and thresholds, not kept by document.  The calibrated log-odds of both views, less the prior that both
contain, add up to the final score, which is given to every document.

Bound (parameter): at most LABELLED labelled rows, taken in hash order, are used for fitting, by one task each time; every
unlabelled document takes part in every round, and every document is scored on its whole text.  The driver holds models
and sums, never rows' features.

Results: doc_id, text_score, meta_score, score (probabilities of good quality), keep (score of at least CUT).  Null and
empty texts are scored like any other; null metadata are a value of their own; without labels of both kinds every
score is 1; repeated rows repeat; of labelled rows that repeat a doc_id the one with the least features is learned from; a
doc_id with several labels has the least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_cells as filter_cells, id_filter, materialize, mix64, release_caches, small_batches, trim

LABELLED = 8_000
ROUNDS = 4
PER_ROUND = 0.05  # share of the unlabelled documents that a view labels in a round
SURE = 0.9  # confidence that a pseudo-label needs
CUT = 0.5
TEXT_DIM = 1024
META_DIM = 128
HELD_OUT = 5  # every fifth labelled row calibrates
CELLS = 64  # confidence cells a unit of log-odds
ID_CELLS = 4096  # parts that the last confidence cell of a quota is taken by
STEPS = 12  # of a round's fit, each a pass over the given rows


# ---------------------------------------------------------------- features
def text_features(raws: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, and how much of the table they cover."""
    lengths = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)
    out = np.zeros((len(raws), TEXT_DIM), np.float32)
    if len(data) >= 3:
        h = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(22)).astype(np.int64)
        doc = np.repeat(np.arange(len(raws)), lengths)
        inside = doc[2:] == doc[:-2]
        out = np.bincount((doc[:-2] * TEXT_DIM + bucket)[inside], minlength=len(raws) * TEXT_DIM).reshape(-1, TEXT_DIM)
    n = np.maximum(lengths - 2, 0)
    covered = (out > 0).sum(1) / np.maximum(np.minimum(n, TEXT_DIM), 1)
    x = np.sqrt(out / np.maximum(n, 1)[:, None]).astype(np.float32)
    return np.concatenate((x, covered[:, None].astype(np.float32)), 1)


def meta_features(raws, langs, sources, n_chars) -> np.ndarray:
    out = np.zeros((len(raws), META_DIM), np.float32)
    for i, (raw, lang, source, n) in enumerate(zip(raws, langs, sources, n_chars)):
        out[i, xxhash.xxh32_intdigest(f"lang={lang}") % 24] = 1
        out[i, 24 + xxhash.xxh32_intdigest(f"source={source}") % 80] = 1
        lines = raw.count(b"\n") + 1
        n = len(raw) if n is None else max(n, 0)
        layout = (np.log1p(n) / 4, np.log1p(lines) / 2, np.log1p(len(raw) / lines) / 4, len(raw) / (n + 1) / 4)
        out[i, 104:108] = layout
        out[i, 108 + min(9, int(layout[0] * 4))] = 1
        out[i, 118 + min(9, int(layout[2] * 4))] = 1
    return out


# ---------------------------------------------------------------- models
def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start=None, steps: int = 250, l2: float = 1e-4):
    """Weighted logistic regression by accelerated gradient steps."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * float((weight * np.einsum("ij,ij->i", x, x)).sum()) + l2)
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(x.dtype), -30, 30)))
        grad = x.T @ (weight * (p - y)).astype(x.dtype) + l2 * ahead
        new = ahead - rate * grad
        nxt = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / nxt * (new - w)
        w, momentum = new, nxt
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def calibrated(model: tuple, x: np.ndarray) -> np.ndarray:
    """Log-odds of a model (weights, slope, offset)."""
    w, slope, offset = model
    return slope * logit(w, x) + offset


def _balanced(y: np.ndarray) -> np.ndarray:
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of calibrated log-odds, by Newton steps with a weak prior on the slope."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def confidence_cells(z: np.ndarray) -> np.ndarray:
    """Signed cells of log-odds of at least SURE, the surest farthest from 0; 0 for documents less sure."""
    size = np.abs(np.clip(z.astype(float), -30, 30))
    cell = np.floor(size * CELLS).astype(np.int32) + 1
    return np.where(size >= np.log(SURE / (1 - SURE)), np.where(z > 0, cell, -cell), 0).astype(np.int32)


def id_cells(ids: np.ndarray) -> np.ndarray:
    """ID_CELLS cells that documents of one confidence are taken by."""
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(ID_CELLS)).astype(np.int32)


def candidates(views: list[np.ndarray], ids: np.ndarray, models, past) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each view's cells under models, 0 where the other view has been given the document in a past round; and what
    the last past round gave: per view the mark (1 good, 0 bad, -1 nothing) that the other view receives."""
    free = [np.ones(len(ids), bool), np.ones(len(ids), bool)]
    hashed, marks = id_cells(ids), [np.full(len(ids), -1, np.int8)] * 2
    for fitted, rules in past:
        marks = []
        for v in (0, 1):
            cell = np.where(free[1 - v], confidence_cells(calibrated(fitted[v], views[v])), 0)
            mark = np.full(len(ids), -1, np.int8)
            for sign, (least, below) in zip((1, -1), rules[v]):
                at = cell * sign
                mark[(at > 0) & ((at > least) | ((at == least) & (hashed < below)))] = sign > 0
            marks.append(mark)
        for v in (0, 1):
            free[1 - v] = free[1 - v] & (marks[v] < 0)
    cells = [np.where(free[1 - v], confidence_cells(calibrated(models[v], views[v])), 0).astype(np.int32) for v in (0, 1)] if models else []
    return cells, marks


def minimise(loss, start: np.ndarray, scale, steps: int = STEPS, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS; loss gives value and gradient, scale applies a fixed approximation of the inverse Hessian."""
    w, (value, grad) = start, loss(start)
    pairs: list = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y, rho in reversed(pairs):
            kept.append(rho * (s @ q))
            q -= kept[-1] * y
        d = scale(q)
        for (s, y, rho), alpha in zip(pairs, reversed(kept)):
            d += s * (alpha - rho * (y @ d))
        slope = -(grad @ d)
        if -slope < tolerance * tolerance:
            break
        step = 1.0
        for _ in range(8):
            new = w - step * d
            v, g = loss(new)
            if v <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - w, g - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y, 1 / (s @ y))]
        done = value - v < tolerance * abs(value)
        w, value, grad = new, v, g
        if done:
            break
    return w


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1).astype(float)


def loss_parts(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic loss and, after it, its gradient."""
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    return np.concatenate(([(weight * (np.logaddexp(0, z) - y * z)).sum()], x.T @ (weight * (p - y))))


def _given_loss(given: DataFrame, w: list[np.ndarray], weight: list[np.ndarray]) -> list[np.ndarray]:
    """loss_parts of both views over the labelled and pseudo-labelled rows, one sum a partition."""

    def run(batches):
        from pyspark import TaskContext

        total = [np.zeros(1 + len(m)) for m in w]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                view, mark, x = (c.slice(at, 500) for c in b.columns)
                view, mark = view.to_numpy(), mark.to_numpy()
                rows = x.to_pylist()
                for v in (0, 1):
                    i = np.flatnonzero(view == v)
                    if len(i):
                        f = _unpack(b"".join(rows[k] for k in i), len(w[v]) - 1)
                        y = mark[i].astype(float)
                        total[v] += loss_parts(w[v], _with_one(f), y, weight[v][mark[i]])
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total[0].tobytes()]), pa.array([total[1].tobytes()])], names=["part", "a", "b"])

    rows = sorted(given.select("view", "mark", "x").mapInArrow(run, "part long, a binary, b binary").collect())  # a row a partition
    return [sum((np.frombuffer(r[1 + v], float) for r in rows), np.zeros(1 + len(w[v]))) for v in (0, 1)]


def refit(weights, inverse, given: DataFrame, counts: np.ndarray, l2: float = 1e-4):
    """Both models' weights on all labelled and given rows; counts: these rows by view and mark; inverse: approximate
    inverse Hessians."""
    per_row = [0.5 / c for c in counts]
    cut = len(weights[0])

    def loss(w):
        parts = _given_loss(given, [w[:cut], w[cut:]], per_row)
        return sum(p[0] for p in parts) + l2 / 2 * (w @ w), np.concatenate([p[1:] for p in parts]) + l2 * w

    w = minimise(loss, np.concatenate(weights), lambda g: np.concatenate([i.astype(float) @ x for i, x in zip(inverse, (g[:cut], g[cut:]))]))
    return [w[:cut], w[cut:]]


def choose(cells: DataFrame, quota: dict[int, float]) -> list[list[tuple[int, int]]]:
    """For each view and sign (good, bad) the least cell that is taken and how many of its id cells: the surest
    documents up to the quota, all of them below it."""
    found: dict = {}
    both = cells.select("hashed", F.posexplode(F.array("cell0", "cell1")).alias("view", "cell"))
    for r in both.filter("cell <> 0").groupBy("view", "cell").count().collect():  # a bounded number of cells
        found.setdefault((r.view, 1 if r.cell > 0 else -1), []).append((abs(r.cell), r["count"]))
    rules, edge = {}, {}
    for key, have in found.items():
        left = int(np.ceil(quota[key[1]]))
        for cell, n in sorted(have, reverse=True):
            if n > left:
                edge[key] = (cell, left)
                break
            left -= n
        else:
            rules[key] = (0, 0)
    at_edge: dict = {}
    if edge:
        on = " or ".join(f"(view = {v} and cell = {sign * cell})" for (v, sign), (cell, _) in edge.items())
        for r in both.filter(on).groupBy("view", "cell", "hashed").count().collect():  # at most four cells
            at_edge.setdefault((r.view, 1 if r.cell > 0 else -1), []).append((r.hashed, r["count"]))
    for (v, sign), (cell, left) in edge.items():
        below = 0
        for hashed, n in sorted(at_edge[v, sign]):
            if left <= 0:
                break
            left, below = left - n, hashed + 1
        rules[v, sign] = (cell, below)
    return [[rules.get((v, sign), (0, 0)) for sign in (1, -1)] for v in (0, 1)]


def _pack(x: np.ndarray) -> pa.Array:
    """Features of rows that are learned from, in half precision."""
    return pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())


def _unpack(r, d: int) -> np.ndarray:
    return np.frombuffer(r, np.float16).reshape(-1, d).astype(np.float32)


def _first_fit(batches):
    """The bounded labelled rows (order, y, text, meta) in one task -> per view first weights and inverse Hessian."""
    rows = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    for v, d in enumerate((TEXT_DIM + 1, META_DIM)):
        x = np.concatenate([_unpack(r[2 + v], d) for r in rows])
        y = np.array([r[1] for r in rows], float)
        share = _balanced(y)
        w = fit_logistic(x, y, share)
        x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
        hessian = (x * (0.25 * share / share.sum()).astype(x.dtype)[:, None]).T @ x
        inverse = np.linalg.inv(hessian.astype(float) + 1e-3 * np.eye(len(w))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([w.tobytes()]), pa.array([inverse.tobytes()])], names=["view", "w", "inverse"])


def _calibrate(held: DataFrame, weights: list[np.ndarray]) -> list[tuple]:
    """Models (weights, slope, offset), from the log-odds of the held-out rows: two numbers a row."""

    def run(batches):
        for b in batches:
            x = [np.concatenate([_unpack(r, d) for r in c.to_pylist()]) for c, d in zip(b.columns[2:], (TEXT_DIM + 1, META_DIM)) if b.num_rows]
            if x:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(logit(w, v).astype(float)) for w, v in zip(weights, x))], names=["o", "y", "z0", "z1"])

    rows = sorted(tuple(r) for r in held.mapInArrow(run, "o long, y long, z0 double, z1 double").collect())
    y = np.array([r[1] for r in rows], float)
    return [(w, *platt(np.array([r[2 + v] for r in rows]), y)) for v, w in enumerate(weights)]


def co_train(labelled: DataFrame, docs: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> dict | None:
    """labelled (o, y, text, meta; bounded) and all documents -> both models with their calibrations, the prior's
    log-odds, the size of the pool (the documents without a label) and the given rows by round, view that receives and
    mark."""
    spark, inputs = docs.sparkSession, _inputs(docs)
    # every HELD_OUT-th row in the order of o calibrates
    nth = F.row_number().over(Window.orderBy("o")) - 1  # over the bounded labelled rows
    parts = materialize(labelled.withColumn("held", nth % HELD_OUT == 0), "labelled")
    held, train = (parts.filter(c).select("o", "y", "text", "meta") for c in ("held", "not held"))
    have = {(r.held, r.y): r["count"] for r in parts.groupBy("held", "y").count().collect()}
    if len(have) < 4:
        discard(parts)
        return None
    first = sorted(train.coalesce(1).mapInArrow(_first_fit, "view long, w binary, inverse binary").collect())
    weights = [np.frombuffer(r.w, float) for r in first]
    inverse = [np.frombuffer(r.inverse, np.float32).reshape(len(w), -1) for r, w in zip(first, weights)]
    models = _calibrate(held, weights)
    base = np.array([[have[False, 0], have[False, 1]]] * 2)
    share = base[0, 1] / base[0].sum()
    pool = inputs.select("doc_id").join(known, "doc_id", "left_anti").count()
    own = [train.select(F.lit(v).alias("view"), F.col("y").cast("int").alias("mark"), F.col(c).alias("x")) for v, c in enumerate(("text", "meta"))]
    past, given, counts, log = [], [], base, []
    if rounds and pool:  # a table like those of the rounds: each pass of a fit is one scan
        given.append(materialize(own[0].unionByName(own[1]), "given"))
    for _ in range(rounds if pool else 0):
        cells = materialize(inputs.mapInArrow(_scorer(models, list(past)), "doc_id long, hashed int, cell0 int, cell1 int").join(known, "doc_id", "left_anti"), "cells")
        quota = {1: PER_ROUND * pool * share, -1: PER_ROUND * pool * (1 - share)}
        rules = choose(cells, quota)
        past.append((models, rules))
        taken = " or ".join(_fits(v, sign, rule) for v in (0, 1) for sign, rule in zip((1, -1), rules[v]))
        chosen = id_filter(cells.filter(taken).select("doc_id"), 2 * sum(int(np.ceil(n)) for n in quota.values()))
        discard(cells)
        picked = inputs.mapInArrow(_picker(list(past), chosen), "doc_id long, view int, mark int, x binary").join(known, "doc_id", "left_anti")
        given.append(materialize(picked.sortWithinPartitions("doc_id", "view", "x").select("view", "mark", "x"), "given"))
        chosen.release()
        new = np.zeros((2, 2), np.int64)
        for r in given[-1].groupBy("view", "mark").count().collect():
            new[r.view, r.mark] = r["count"]
        log.append(new.tolist())
        counts = counts + new
        if not new.sum():
            break
        every = spark.read.schema(given[0].schema).parquet(*(g._litspark_path for g in given))
        weights = refit(weights, inverse, every, counts)
        models = _calibrate(held, weights)
    discard(parts, *given)
    prior = float(np.log(have[True, 1] / have[True, 0]))
    return {"models": models, "prior": prior, "pool": pool, "given": log}


def _fits(view: int, sign: int, rule: tuple[int, int]) -> str:
    """SQL condition of what a rule takes, as candidates() decides it."""
    at = f"{sign} * cell{view}"
    return f"({at} > 0 and ({at} > {rule[0]} or ({at} = {rule[0]} and hashed < {rule[1]})))"


def combine(model: dict | None, views: list[np.ndarray]) -> list[np.ndarray]:
    """text_score, meta_score and the combined score."""
    if model is None:
        return [np.ones(len(views[0]))] * 3
    z = [calibrated(m, v) for m, v in zip(model["models"], views)]
    prob = lambda x: 1 / (1 + np.exp(-np.clip(x.astype(float), -30, 30)))
    return [prob(z[0]), prob(z[1]), prob(z[0] + z[1] - model["prior"])]


# ---------------------------------------------------------------- DataFrame operators
def _inputs(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("raw"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def _blocks(batch, size: int = 500_000):
    """Row ranges of about size bytes of text."""
    release_caches()
    raws = batch.column(batch.schema.names.index("raw"))
    start, used = 0, 0
    for i, n in enumerate(pa.compute.binary_length(raws).to_pylist()):
        used += n
        if used >= size or i - start >= 500:
            yield start, i + 1
            start, used = i + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows
    trim()


def _views(part) -> list[np.ndarray]:
    col = lambda n: part.column(part.schema.names.index(n)).to_pylist()
    raws = col("raw")
    return [text_features(raws), meta_features(raws, col("lang"), col("source"), col("n_chars"))]


def _scorer(models, past):
    """Batches -> the cells of the documents that a view is sure of and the other has not been given."""

    def run(batches):
        for b in batches:
            for x, y in _blocks(b):
                part = b.slice(x, y - x)
                ids = part.column(0).to_numpy()
                cells, _ = candidates(_views(part), ids, models, past)
                at = np.flatnonzero((cells[0] != 0) | (cells[1] != 0))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[at], id_cells(ids[at]), cells[0][at], cells[1][at]))], names=["doc_id", "hashed", "cell0", "cell1"])

    return run


def _picker(past, chosen):
    """Batches -> what the last round gives: doc_id, the view that receives it, its mark and that view's features.
    chosen holds the ids that are given, and a few others."""
    mask = chosen.probe()

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(mask(filter_cells(b.column(0).to_numpy()))))
            for x, y in _blocks(b):
                part = b.slice(x, y - x)
                ids, views = part.column(0).to_numpy(), _views(part)
                _, marks = candidates(views, ids, None, past)
                for v in (0, 1):
                    at = np.flatnonzero(marks[v] >= 0)
                    rows = _pack(views[1 - v][at])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), 1 - v, np.int32)), pa.array(marks[v][at].astype(np.int32)), rows], names=["doc_id", "view", "mark", "x"])

    return run


def labelled_rows(docs: DataFrame, known: DataFrame, labelled: int) -> DataFrame:
    """o (hash order), y, text, meta of at most labelled labelled documents, the first in hash order."""
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.xxhash64("doc_id", F.lit("quality"))
    have = materialize(ids.join(known, "doc_id").select("doc_id", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), order.alias("o")), "known")
    n = have.count()
    if n > 2 * labelled:  # rows above this share of the hashes are not among the first, but with vanishing probability
        have = have.filter(F.col("o") < int(-(1 << 63) + (1 << 64) * 1.5 * labelled / n))
    sample = {r.doc_id: (r.o, r.y) for r in have.orderBy("o", "doc_id").limit(labelled).collect()}  # at most labelled rows
    discard(have)
    chosen = docs.sparkSession.sparkContext.broadcast(sample)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("meta", pa.binary())])

    def features(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            at = [i for i, d in enumerate(ids) if d in chosen.value]
            if at:
                part = b.take(pa.array(at))
                for x, y in _blocks(part):
                    v = _views(part.slice(x, y - x))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at[x:y]]), *map(_pack, v)], schema=schema)

    rows = _inputs(docs).mapInArrow(features, "doc_id long, text binary, meta binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "meta")).alias("f"))  # one row of a repeated doc_id
    table = docs.sparkSession.createDataFrame([(d, *v) for d, v in sample.items()], "doc_id long, o long, y long")
    return rows.join(F.broadcast(table), "doc_id").select("o", "y", "f.text", "f.meta")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict | None:
    """Co-train on a bounded sample of labelled rows, in hash order, and all unlabelled documents."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    known = materialize(known, "known")  # joined several times a round
    model = co_train(labelled_rows(docs, known, labelled), docs, known.select("doc_id"), rounds)
    discard(known)
    return model


SCORES = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT, **bounds) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars), labels (doc_id, quality) -> the scores of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def run(batches):
        for b in batches:
            for x, y in _blocks(b):
                part = b.slice(x, y - x)
                scores = [np.round(s, 6) for s in combine(model.value, _views(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scores), pa.array(scores[2] >= cut)], schema=SCORES)

    return _inputs(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, **bounds) -> DataFrame:
    """The documents of score cut or more, with their columns doc_id, text, lang, source, n_chars; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def run(batches):
        for b in batches:
            for x, y in _blocks(b):
                part = b.slice(x, y - x)
                yield part.filter(pa.array(np.round(combine(model.value, _views(part))[2], 6) >= cut))

    kept = _inputs(docs).mapInArrow(run, "doc_id long, raw binary, lang string, source string, n_chars long")
    return kept.select("doc_id", F.decode("raw", "UTF-8").alias("text"), "lang", "source", "n_chars")
