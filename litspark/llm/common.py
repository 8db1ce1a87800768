"""Shared parts of the training-data operators: shared storage, text batches and array kernels.

Conventions that hold for every operator here:

* a row without ``doc_id`` cannot be addressed by a result and is left out;
* a null text is an empty text unless an operator says otherwise;
* extra columns of the input are ignored, whatever their names, as each operator first selects what it reads;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling polynomial
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"  # the words of the contracts: what bytes.split() gives


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one only where both are one process (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="litspark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._litspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_litspark_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand rows at a time, unless the session names another number: with Spark's default
    of 10,000 each task's Arrow buffers, outside the heap, are tens of MB."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text as UTF-8 bytes; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b"")).alias("raw"),
    ).filter("doc_id is not null")


def row_texts(docs: DataFrame) -> DataFrame:
    """doc_texts with t, a hash of the text that tells rows of one doc_id apart."""
    return doc_texts(docs).withColumn("t", F.hash("raw"))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- batches
_process_caches: list = []  # dicts that a worker process keeps from task to task


def keep_in_process(cache: dict) -> dict:
    _process_caches.append(cache)
    return cache


def release_caches() -> None:
    """Worker processes serve one operator after another: one that keeps nothing frees what others kept."""
    for cache in _process_caches:
        cache.clear()


def trim() -> None:
    """Give memory that a worker process has freed back to the system: processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def text_blocks(batches, max_bytes: int = 1_000_000, caches: bool = False):
    """Lists of (doc_id, bytes) of about max_bytes from Arrow batches with doc_id and raw; a long text is whole.  caches:
    whether the operator uses what processes keep."""
    if not caches:
        release_caches()
    ids, texts, size = [], [], 0
    for batch in batches:
        names = batch.schema.names
        raws = batch.column(names.index("raw"))
        for start in range(0, batch.num_rows, 512):
            part = raws.slice(start, 512).to_pylist()
            for i, raw in zip(batch.column(names.index("doc_id")).slice(start, 512).to_pylist(), part):
                ids.append(i)
                texts.append(raw)
                size += len(raw) + 16
                if size >= max_bytes:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    ids = texts = None
    trim()


def row_blocks(batches, max_bytes: int = 1_000_000):
    """Lists of (doc_id, t) pairs and of bytes, as text_blocks."""
    keyed = (
        pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column("doc_id"), b.column("t")], ["doc_id", "t"]), b.column("raw")], names=["doc_id", "raw"])
        for b in batches
    )
    for keys, texts in text_blocks(keyed, max_bytes):
        yield np.array([(k["doc_id"], k["t"]) for k in keys], np.int64).reshape(-1, 2), texts


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


# ---------------------------------------------------------------- array kernels (uint64, wrapping)
def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def rolling(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every run of ``width`` elements, by doubling; ends before the last width - 1 elements."""
    if len(h) < width:
        return np.empty(0, U64)
    power, have, out, done = h, 1, None, 0
    left = width
    while left:
        if left & 1:
            if out is None:
                out, done = power, have
            else:
                n = len(h) - (done + have) + 1
                out = out[:n] * U64(pow(base, have, 1 << 64)) + power[done : done + n]
                done += have
        left >>= 1
        if left:
            n = len(h) - 2 * have + 1
            power = power[:n] * U64(pow(base, have, 1 << 64)) + power[have : have + n]
            have *= 2
    return out


def sliding(v: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of ``width`` elements."""
    have = 1
    while have * 2 <= width:
        v = op(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = op(v[: len(v) - (width - have)], v[width - have :])
    return v


def run_starts(x: np.ndarray) -> np.ndarray:
    """Indices at which a run of equal elements starts."""
    if not len(x):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length - 1."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


# ---------------------------------------------------------------- sketches of repeated cells
def shard_count(spark: SparkSession) -> int:
    """Power of two that grows with the shuffle partitions, so that a shard's share stays bounded."""
    n = 64
    while n < 4 * n_parts(spark) and n < 1 << 16:
        n *= 2
    return n


def partition_sketch(cells: np.ndarray, shards: int):
    """One partition's sparse sketch: per shard the sorted 32-bit cells, twice where counted more than once."""
    cells = np.sort(cells)
    first = run_starts(cells)
    again = np.diff(np.append(first, len(cells))) > 1
    cells = np.repeat(cells[first], 1 + again)
    shard = (cells.astype(np.int64) * shards) >> 32
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in range(shards):
        if cuts[s + 1] > cuts[s]:
            yield s, cells[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes()


def shard_bits(shard: int, shards: int) -> np.ndarray:
    """First and last cell of a shard."""
    return np.array([-(-(shard << 32) // shards), -(-((shard + 1) << 32) // shards) - 1])


SKETCH = pa.schema([("shard", pa.int32()), ("cells", pa.binary())])
SKETCH_DDL = "shard int, cells binary"


def sketch_rows(cells: list[np.ndarray], shards: int):
    if cells:
        rows = list(partition_sketch(np.concatenate(cells), shards))
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield record(SKETCH, [r[0] for r in part], [r[1] for r in part])


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Add partition sketches cell by cell; keeps the cells whose merged count is at least two (never too low)."""
    spark = sketches.sparkSession

    def merge(batches):
        have: dict[int, list] = {}
        for b in batches:
            for s, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have.setdefault(s, []).append(np.frombuffer(cells, np.uint32))
                if len(have[s]) >= 64:  # bounded: every cell at most twice
                    x = np.sort(np.concatenate(have[s]))
                    keep = np.ones(len(x), bool)
                    keep[2:] = x[2:] != x[:-2]
                    have[s] = [x[keep]]
        for s, parts in have.items():
            x = np.sort(np.concatenate(parts))
            twice = np.unique(x[1:][x[1:] == x[:-1]])
            if len(twice):
                yield record(SKETCH, [s], [twice.tobytes()])

    return sketches.repartition(n_parts(spark), "shard").mapInArrow(merge, SKETCH_DDL)


SMALL_BITS = 23
MAX_BITS = 28  # 32 MB: the bound of what a cell filter broadcasts, unless it is given less


class CellFilter:
    """Bitmap of the repeated cells, folded to at most 2**MAX_BITS bits; folding only adds false positives."""

    def __init__(self, cells: DataFrame, n: int | None = None, most: int = MAX_BITS, make=None):
        """cells: sketch rows, merged or of partitions, or what make (over Arrow batches) makes such rows of; n: about how
        many cells they hold; most: bound of the bits' power."""
        spark = cells.sparkSession
        if n is None:
            n = int((cells.select(F.sum(F.octet_length("cells")).alias("n")).first().n or 0) // 4)
        self.bits = min(most, max(16, int(np.ceil(np.log2(max(1, n) * 64)))))
        shift, size = 32 - self.bits, 1 << self.bits

        def fold(batches):
            """Each shard's stretch of the bitmap: together no more than the whole."""
            have: dict[int, tuple] = {}
            for b in batches:
                for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.unique(np.frombuffer(c, np.uint32) >> np.uint32(shift))
                    if s not in have:
                        shards = shard_bits(s, self.shards) >> shift
                        have[s] = (int(shards[0]) >> 3, np.zeros((int(shards[1]) >> 3) - (int(shards[0]) >> 3) + 1, np.uint8))
                    base, local = have[s]
                    np.bitwise_or.at(local, (x >> np.uint32(3)).astype(np.int64) - base, np.uint8(1) << (x & np.uint32(7)).astype(np.uint8))
            for base, local in have.values():
                yield record(SKETCH, [base], [local.tobytes()])

        self.shards = shard_count(spark)
        bitmap = np.zeros(size >> 3, np.uint8)
        # bitmaps of disjoint stretches, or a few whole ones of a small filter, made and folded by the same worker
        if self.bits <= SMALL_BITS:
            bits = cells.coalesce(4).mapInArrow(lambda b: fold(make(b) if make else b), SKETCH_DDL)
        else:
            bits = (cells.mapInArrow(make, SKETCH_DDL) if make else cells).repartition(n_parts(spark), "shard").mapInArrow(fold, SKETCH_DDL)
        for r in bits.collect():
            part = np.frombuffer(r.cells, np.uint8)
            bitmap[r.shard : r.shard + len(part)] |= part
        self.repeated = n
        self.bitmap = spark.sparkContext.broadcast(bitmap)

    def probe(self):
        """A function from cells (uint32) to a mask, for use on executors."""
        shift, bitmap = 32 - self.bits, self.bitmap

        def mask(cells: np.ndarray) -> np.ndarray:
            x = cells >> np.uint32(shift)
            return (bitmap.value[x >> np.uint32(3)] >> (x & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0

        return mask

    def release(self):
        """Free the bitmap on driver and executors, once no table that probes it has still to be made."""
        self.bitmap.destroy()


def id_cells(ids) -> np.ndarray:
    return (mix64(np.asarray(ids, np.int64).view(U64) + U64(7)) >> U64(32)).astype(np.uint32)


def id_filter(ids: DataFrame, n: int | None = None) -> CellFilter:
    """Bitmap that every listed id (the first column) passes; others may pass too.  n: about how many are listed."""
    shards = shard_count(ids.sparkSession)

    def build(batches):
        yield from sketch_rows([id_cells(b.column(0).to_numpy()) for b in batches], shards)

    return CellFilter(ids, ids.count() if n is None else n, make=build)
