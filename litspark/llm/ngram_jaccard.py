"""N-gram Jaccard join with set-relation skipping.

Documents become sets of 5-word shingles.  Equal sets form a class and share their answers.  Classes are joined by
prefix filtering over inverted lists, with these relations between sets:

* index-level skipping: lists are sorted by set size and hold each shingle's position in its set, so stretches of a
  list whose size or position cannot reach the required overlap are skipped;
* answer-level skipping: a set first joins its list's leader.  From then on it has the answers of the leader's
  component, and only members of other components are compared with it.  What is known of two sets' overlap with a
  common pivot bounds theirs from both sides, which proves or excludes most links without reading either set.

Shingles are ordered by a count sketch of all documents (any fixed order is exact; rare first keeps the lists short).
Links are decided on whole sets of 64-bit shingle hashes, so a component is exact.  Only class representatives are in
lists: a bitmap finds most others before they are moved, a semi-join all.  Pairs in one component are never formed, and
later rounds only read lists longer than what is settled; documents made of the same few stock passages still give pairs that
only their parity bitmaps exclude.  A list
longer than a task's fair share is dealt by salted doc_ids to several; in the end the sets of its lesser components visit
each of the parts, so no pair is lost.

Results: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links).  Null, empty and blank texts have the empty set
and no link; equal texts share a component; a repeated row gets its document's answer; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    U64, CellFilter, discard, doc_texts, id_cells, id_filter, materialize, mix64, n_parts, record, rolling, spread,
    text_blocks, trim,
)
from .components import components

SHINGLE = 5
THRESHOLD = 80  # per cent
LEVEL_BITS = 21  # cells of the document-frequency sketch: 2 MB of levels are broadcast, whatever the input
FOLD = 1024  # bits of a set's parity bitmap
HOT_LIST = 4096  # entries; a list above this and above a task's fair share is dealt to several
ROUNDS = (16, 1024, None)  # how far apart in a list the pairs of each round lie; None: all that are left


def required(nx, ny, t=THRESHOLD):
    """Least overlap of a link: 100 * o >= t * (nx + ny - o)."""
    return -(-t * (nx + ny) // (100 + t))


def shingle_sets(raws: list[bytes], k: int = SHINGLE):
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [r.lower().split() for r in raws]
    lengths = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), U64, int(lengths.sum()))
    grams = mix64(rolling(hashes, k))
    out, at = [], 0
    for n in lengths.tolist():
        if n >= k:
            s = np.sort(grams[at : at + n - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(mix64(rolling(hashes[at : at + n], n) + U64(n)))  # the whole sequence as one shingle
        else:
            out.append(np.empty(0, U64))
        at += n
    return out


META = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("fold", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())]
)
META_DDL = "doc_id long, n long, d1 long, d2 long, fold array<long>, part int, counts binary"
SLICES = 32


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """The set folded to FOLD bits, a bit for the parity of its elements there, as 64-bit words.  Two bitmaps differ in
    no more bits than the sets in elements."""
    odd = np.bincount((s & U64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _cells(sets, bits):
    return (sets >> U64(64 - bits)).astype(np.int64)


def describe(texts: DataFrame, k: int, bits: int) -> DataFrame:
    """Set size, digest and parity bitmap of every document, and each partition's document-frequency sketch."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for ids, raws in text_blocks(batches):
            sets = shingle_sets(raws, k)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            folds = _lists([parity_bitmap(s) for s in sets])
            yield record(META, ids, [len(s) for s in sets], pa.array(digests[:, 0]), pa.array(digests[:, 1]), folds, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()))
            cells, n = np.unique(_cells(np.concatenate(sets), bits), return_counts=True)
            counts[cells] += n.astype(np.uint32)
        for s, c in enumerate(np.split(np.minimum(counts, 65535).astype(np.uint16), SLICES)):
            if c.any():
                none = pa.nulls(1, pa.int64())
                yield record(META, none, none, none, none, pa.nulls(1, META.field("fold").type), [s], [c.tobytes()])

    return texts.mapInArrow(run, META_DDL)


def frequency_levels(meta: DataFrame, bits: int) -> np.ndarray:
    """Quarter-log levels of the summed sketch, one byte a cell."""
    width = (1 << bits) // SLICES

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total.setdefault(s, np.zeros(width, np.int64)).__iadd__(np.frombuffer(c, np.uint16))
        for s, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.minimum(4 * np.log2(t + 1.0), 255).astype(np.uint8).tobytes()], pa.binary())], ["part", "counts"])

    levels = np.zeros(1 << bits, np.uint8)
    rows = meta.filter("part is not null").select("part", "counts").repartition(min(SLICES, n_parts(meta.sparkSession)), "part")
    for r in rows.mapInArrow(add, "part int, counts binary").collect():  # a byte a cell
        levels[r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.uint8)
    return levels


ENTRY = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
ENTRY_DDL = "token long, doc_id long, n int, pos int"


def prefix_entries(texts, k, threshold, bits, levels, wanted: CellFilter) -> DataFrame:
    """Prefix shingles of each class representative, rarest first, with their positions; after them, rows without
    doc_id hold how often (n) the partition has a shingle that it has more than once."""
    mask = wanted.probe()

    def run(batches):
        seen = []
        for ids, raws in text_blocks(batches):
            keep = np.flatnonzero(mask(id_cells(ids)))
            sets = shingle_sets([raws[i] for i in keep], k)
            tokens, sizes, prefix = [], [], []
            for s in sets:
                order = levels.value[_cells(s, bits)].astype(U64) << U64(56) | s >> U64(8)
                n = len(s)
                p = n - -(-threshold * n // 100) + 1 if n else 0
                tokens.append(np.sort(order)[:p])
                sizes.append(n)
                prefix.append(p)
            if tokens:
                prefix = np.array(prefix)
                rows = np.repeat(np.arange(len(sets)), prefix)
                pos = spread(np.zeros(len(sets), np.int64), prefix)
                docs = np.array(ids, np.int64)[keep]
                seen.append(np.concatenate(tokens).view(np.int64))
                yield record(ENTRY, pa.array(seen[-1]), pa.array(docs[rows]), pa.array(np.array(sizes, np.int32)[rows]), pa.array(pos.astype(np.int32)))
        if seen:
            names, counts = np.unique(np.concatenate(seen), return_counts=True)
            names, counts = names[counts > 1], counts[counts > 1]
            yield record(ENTRY, pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(counts.astype(np.int32)), pa.nulls(len(names), pa.int32()))

    return texts.mapInArrow(run, ENTRY_DDL)


def salted(entries: DataFrame, classes: DataFrame, hot_list: int) -> tuple[DataFrame, list]:
    """entries of class representatives with their list: the token, or one of a hot token's salted parts; and these parts:
    list, token, their number.  Both are fewer than a few per shuffle partition.  The bitmap of representatives lets others
    pass, most of them once it is full; the semi-join leaves exactly the representatives."""
    spark = entries.sparkSession
    limit = max(hot_list, -(-entries.count() // n_parts(spark)))
    found = entries.filter("doc_id is null").groupBy("token").agg(F.sum("n").alias("c")).filter(F.col("c") > limit)
    entries = entries.filter("doc_id is not null").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select(*ENTRY.names)
    found = [(r.token, int(-(-2 * r.c // limit))) for r in found.collect()]
    if not found:
        return entries.withColumnRenamed("token", "list"), []
    hot = spark.createDataFrame(found, "base long, salts int")
    name = lambda salt: F.xxhash64("base", salt.cast("long"))
    parts = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(name(F.col("salt")).alias("list"), "base", "salts")
    rows = entries.join(F.broadcast(hot), entries.token == hot.base, "left")
    part = F.when(F.col("salts").isNull(), F.col("token")).otherwise(name(F.pmod(F.xxhash64("doc_id"), F.col("salts"))))
    return rows.select(part.alias("list"), "doc_id", "n", "pos"), [tuple(r) for r in parts.collect()]


def whole_lists(batches, n_columns: int):
    """Arrays of consecutive whole lists (equal first column) from batches sorted by it."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_columns)]
        last = cols[0][-1]
        if held and held[0][0][0] == last:  # one long list goes on
            held.append(cols)
            continue
        cut = int(np.searchsorted(cols[0], last, side="left"))
        held.append([c[:cut] for c in cols])
        out = [np.concatenate(c) for c in zip(*held)]
        if len(out[0]):
            yield out
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]
    held = None
    trim()


def may_link(nx, px, ny, py, t=THRESHOLD):
    """Size and position bounds: whether sets whose first common shingle has these positions can link."""
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return (100 * small >= t * large) & (np.minimum(nx - px, ny - py) >= required(nx, ny, t))


INDEX = pa.schema([("list", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("size", pa.int32()), ("lead", pa.int64())])
INDEX_DDL = "list long, doc_id long, n int, pos int, size int, lead long"


def inverted_lists(entries: DataFrame, parts: list, threshold: int) -> DataFrame:
    """Lists of at least two sets, and all parts of hot ones, sorted by set size: each entry with its list's size, its
    leader where it may link to it, and for parts the base and number of parts (salts)."""
    spark = entries.sparkSession
    kept = np.sort(np.array([p[0] for p in parts], np.int64))

    def run(batches):
        for name, doc, n, pos in whole_lists(batches, 4):
            fresh = np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))
            name, doc, n, pos = name[fresh], doc[fresh], n[fresh].astype(np.int64), pos[fresh].astype(np.int64)
            head = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            size = np.diff(np.append(head, len(name)))
            keep = (size > 1) | np.isin(name[head], kept)
            at = np.flatnonzero(np.repeat(keep, size))
            if not len(at):
                continue
            first, size = np.repeat(head, size)[at], np.repeat(size, size)[at]
            block = np.floor(np.log(n[at]) / np.log(100 / threshold)).astype(np.int64)
            new = np.concatenate(([True], (block[1:] != block[:-1]) | (name[at][1:] != name[at][:-1])))
            second = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            lead = np.full(len(at), -1, np.int64)
            for who in (second, first):
                ok = (who != at) & may_link(n[at], pos[at], n[who], pos[who], threshold)
                lead[ok] = doc[who][ok]
            small = lambda x: pa.array(x.astype(np.int32))
            yield record(INDEX, pa.array(name[at]), pa.array(doc[at]), small(n[at]), small(pos[at]), small(size), pa.array(lead))

    rows = entries.repartition(n_parts(spark), "list").sortWithinPartitions("list", "n", "doc_id")
    rows = rows.mapInArrow(run, INDEX_DDL)
    if not parts:
        return rows.select("*", F.lit(0).cast("long").alias("base"), F.lit(0).alias("salts"))
    table = F.broadcast(spark.createDataFrame(parts, "list long, base long, salts int"))
    return rows.join(table, "list", "left").fillna(0, ["base", "salts"])


def load_sets(texts, k, wanted: CellFilter) -> DataFrame:
    """doc_id, elements of the wanted documents, made anew from their texts: a set is larger than its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("elements", pa.list_(pa.int64()))])
    mask = wanted.probe()

    def run(batches):
        for ids, raws in text_blocks(batches):
            keep = np.flatnonzero(mask(id_cells(ids)))
            if len(keep):
                yield record(schema, [ids[i] for i in keep], _lists(shingle_sets([raws[i] for i in keep], k)))

    return texts.mapInArrow(run, "doc_id long, elements array<long>")


def possible(pairs: DataFrame, folds: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose parity bitmaps don't already exclude the link; small rows decide before sets are made."""
    side = lambda x: folds.select(F.col("class_id").alias(x), F.col("n").alias("n" + x), F.col("fold").alias("f" + x))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = both.withColumn("apart", apart)
    return both.filter(f"100L * (na + nb - apart) >= {threshold}L * (na + nb + apart)").select("a", "b")


def verify(pairs: DataFrame, folds: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Overlap of each pair (a, b) on whole sets: a, b, na, nb, o, linked; pairs that bitmaps exclude are left out.
    Only the sets of the pairs left are made and moved."""
    maybe = materialize(possible(pairs, folds, threshold), "maybe")
    if maybe.isEmpty():
        return maybe.select("a", "b", *(F.lit(0).alias(c) for c in ("na", "nb", "o")), F.lit(False).alias("linked"))
    wanted = maybe.select(F.explode(F.array("a", "b")).alias("doc_id"))
    found = id_filter(wanted)
    sets = load_sets(texts, k, found).join(wanted.distinct(), "doc_id", "left_semi")  # the bitmap lets others pass
    sets = materialize(sets, "elements")
    found.release()
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("elements").alias("s" + x))
    both = maybe.join(side("b"), "b").join(side("a"), "a")
    found = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("o"))
    known = materialize(found.withColumn("linked", F.expr(f"100L * o >= {threshold}L * (na + nb - o)")), "known")
    discard(maybe, sets)
    return known


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


class _Lists:
    """Entries of whole lists as arrays, and what is known of pairs of them."""

    def __init__(self, arrays, threshold: int):
        self.name, self.doc, self.n, self.pos, self.comp, self.pivot, self.o, self.pn = arrays
        self.n, self.pos, self.o, self.pn = (x.astype(np.int64) for x in (self.n, self.pos, self.o, self.pn))
        self.t = threshold

    def decide(self, i, j):
        """Pairs of entries -> (a, b, sure) of those of different components that are not excluded by size, position or
        a common pivot."""
        ok = (self.comp[i] != self.comp[j]) & may_link(self.n[i], self.pos[i], self.n[j], self.pos[j], self.t)
        i, j = i[ok], j[ok]
        need = required(self.n[i], self.n[j], self.t)
        shared = (self.pivot[j] == self.pivot[i]) & (self.pivot[i] >= 0)
        most = np.minimum(self.o[i], self.o[j]) + np.minimum(self.n[i] - self.o[i], self.n[j] - self.o[j])
        least = self.o[i] + self.o[j] - self.pn[i]
        ok = ~(shared & (most < need))
        i, j, sure = i[ok], j[ok], (shared & (least >= need))[ok]
        return np.minimum(self.doc[i], self.doc[j]), np.maximum(self.doc[i], self.doc[j]), sure

    def within(self, i: int, lo: int, hi: int):
        """The stretch of lo .. hi, sorted by size, whose sizes allow a link with entry i (block skipping)."""
        n = self.n[lo:hi]
        return lo + int(np.searchsorted(n, -(-self.t * self.n[i] // 100))), lo + int(np.searchsorted(n, 100 * self.n[i] // self.t, side="right"))


def open_pairs(open_lists: DataFrame, near: int, far: int | None, threshold: int) -> DataFrame:
    """Pairs of different components in one list, more than near and at most far places apart, that may link; sure
    where their overlaps with a common pivot already prove the link, left out where they exclude it."""

    def run(batches):
        for arrays in whole_lists(batches, 8):
            have = _Lists(arrays, threshold)
            if far is not None and far - near <= 64:  # a few distances: all lists at once
                for d in range(near + 1, far + 1):
                    i = np.flatnonzero(have.name[d:] == have.name[:-d])
                    if not len(i):
                        break
                    yield record(PAIRS, *map(pa.array, have.decide(i, i + d)))
                continue
            head = np.flatnonzero(np.concatenate(([True], have.name[1:] != have.name[:-1])))
            for lo, hi in zip(head.tolist(), np.append(head[1:], len(have.name)).tolist()):
                names, counts = np.unique(have.comp[lo:hi], return_counts=True)
                if len(names) < 2 or hi - lo <= near + 1:
                    continue
                main = names[np.argmax(counts)]
                got = []
                for i in (np.flatnonzero(have.comp[lo:hi] != main) + lo).tolist():
                    start, stop = have.within(i, lo, hi)
                    reach = hi if far is None else far
                    j = np.arange(max(start, i - reach), min(stop, i + reach + 1))
                    j = j[(np.abs(j - i) > near) & ((have.comp[j] == main) | (j < i))]  # a pair of two lesser ones once
                    if len(j):
                        got.append(have.decide(np.full(len(j), i), j))
                if got:
                    yield record(PAIRS, *(pa.array(np.concatenate(g)) for g in zip(*got)))

    spark = open_lists.sparkSession
    rows = open_lists.select(*ENTRIES).repartition(n_parts(spark), "list").sortWithinPartitions("list", "n", "doc_id")
    return rows.mapInArrow(run, PAIRS_DDL).groupBy("a", "b").agg(F.max("sure").alias("sure"))


ENTRIES = ("list", "doc_id", "n", "pos", "comp", "pivot", "o", "pn")
PAIRS_DDL = "a long, b long, sure boolean"


def visiting_pairs(hot: DataFrame, threshold: int) -> DataFrame:
    """As open_pairs, for pairs whose entries lie in different parts of one hot list: the entries outside the list's
    largest component visit all other parts."""

    def run(batches):
        for *arrays, visits in whole_lists(batches, 9):
            have, visits = _Lists(arrays, threshold), visits.astype(bool)
            head = np.flatnonzero(np.concatenate(([True], have.name[1:] != have.name[:-1])))
            for lo, hi in zip(head.tolist(), np.append(head[1:], len(have.name)).tolist()):
                home = np.flatnonzero(~visits[lo:hi]) + lo
                for i in (np.flatnonzero(visits[lo:hi]) + lo).tolist():
                    start, stop = have.within(i, lo, hi)
                    j = home[np.searchsorted(home, start) : np.searchsorted(home, stop)]
                    if len(j):
                        yield record(PAIRS, *map(pa.array, have.decide(np.full(len(j), i), j)))

    spark = hot.sparkSession
    main = hot.groupBy("base", "comp").agg(F.count("*").alias("c")).groupBy("base").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"))
    lesser = hot.join(main, "base").filter("comp <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    visitors = lesser.withColumn("own", F.col("list")).withColumn("list", F.xxhash64("base", F.col("salt").cast("long"))).filter("list <> own")
    rows = hot.select(*ENTRIES, F.lit(False).alias("visits")).unionByName(visitors.select(*ENTRIES, F.lit(True).alias("visits")))
    rows = rows.repartition(n_parts(spark), "list").sortWithinPartitions("list", "n", "doc_id")
    return rows.mapInArrow(run, PAIRS_DDL).groupBy("a", "b").agg(F.max("sure").alias("sure"))


def jaccard_join(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, bits: int = LEVEL_BITS, hot_list: int = HOT_LIST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set)."""
    texts, spark = doc_texts(docs), docs.sparkSession
    meta = materialize(describe(texts, k, bits), "sets")
    levels = spark.sparkContext.broadcast(frequency_levels(meta, bits))
    every = meta.filter("part is null")
    folds = every.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("fold").alias("fold"))
    classes = materialize(folds, "classes")

    first = id_filter(classes.select("class_id"))
    entries = materialize(prefix_entries(texts, k, threshold, bits, levels, first), "entries")
    first.release()
    levels.destroy()
    index = materialize(inverted_lists(*salted(entries, classes, hot_list), threshold), "index")
    discard(entries)

    # each set first joins the leader of most of its lists and its smallest one; the rounds below see to the rest
    leads = index.filter("lead >= 0").groupBy("doc_id", "lead").agg(F.count("*").alias("c"))
    leads = leads.groupBy("doc_id").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("most"), F.min("lead").alias("least"))
    leads = leads.select("doc_id", F.explode(F.array_distinct(F.array("most", "least"))).alias("lead"))
    pairs = leads.select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct()
    known = verify(pairs, classes, texts, k, threshold)
    links = known.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(links)
    ends = [known.select(F.col(x).alias("doc_id"), F.struct("o", F.col(y).alias("pivot"), F.col("n" + y).alias("pn")).alias("p")) for x, y in ("ab", "ba")]
    pivots = ends[0].unionByName(ends[1]).groupBy("doc_id").agg(F.max("p").alias("p")).select("doc_id", "p.pivot", "p.o", "p.pn")

    near = 0
    for far in ROUNDS:
        left = index.filter(f"size > {near + 1} or salts > 0")
        if left.isEmpty():
            break
        named = left.drop("lead").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        named = named.withColumn("comp", F.coalesce("root", "doc_id")).join(pivots, "doc_id", "left")
        named = named.select(
            "list", "doc_id", "n", "pos", "comp", "base", "salts",
            F.coalesce("pivot", F.lit(-1)).alias("pivot"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("pn", F.lit(0)).alias("pn"),
        )
        todo = open_pairs(named, near, far, threshold)
        if far is None:
            hot = named.filter("salts > 0")
            if not index.filter("salts > 0").isEmpty():
                todo = todo.unionByName(visiting_pairs(hot, threshold)).groupBy("a", "b").agg(F.max("sure").alias("sure"))
        todo = materialize(todo, "open")
        near = far
        if not todo.isEmpty():
            found = verify(todo.filter("not sure").select("a", "b"), classes, texts, k, threshold)
            forest = labels.select(F.col("node").alias("u"), F.col("root").alias("v"))
            new = found.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
            sure = todo.filter("sure").select(F.col("a").alias("u"), F.col("b").alias("v"))
            before, labels = labels, components(forest.unionByName(new).unionByName(sure))
            discard(before, found)
        discard(todo)
    result = (
        every.join(classes.select("d1", "d2", "class_id"), ["d1", "d2"], "left")
        .join(labels.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    )
    result = materialize(result, "components")
    discard(meta, classes, index, known, labels)
    return result


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def brute_force(rows, k: int = SHINGLE, threshold: int = THRESHOLD):
    """Reference answer for tests: every pair, over sets of word tuples."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d)) for d in ids]
