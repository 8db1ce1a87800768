"""Substring dedup over word windows with a count-min prefilter.

Pass 1 gives every partition a sparse count-min sketch of ROWS hash rows; the merged sketch, whose least row counts, never
underestimates how often a window occurs.  A window is counted under the least hashed 6-word gram inside it (its
minimizer): equal windows share that gram and each occurrence has its own place of it, so a gram counted once cannot
belong to a repeated window.  Counts stop at two, which is all that is asked.  Rows hold as many cells as grams occur
(of 2**32) and are folded for the second pass to a width that grows with the repeated cells, to 2**(28 - 1) bits a row at
most; beyond that they let more through, never less.  Pass 2 groups exactly, by 128-bit digests, only the windows
estimated repeated; none is lost.

Results: a window repeats if its word sequence also starts earlier (smaller doc_id, or the same document and an earlier
start).  Null and empty texts have no words; a text shorter than the window is kept whole; rows repeating a doc_id
count as the same place, so at equal starts neither removes the other, and each loses only words of its own text; an
empty table gives an empty result; other columns are ignored, or carried if named.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    MAX_BITS, SKETCH_DDL, U64, CellFilter, discard, materialize, merge_sketches, mix64, record, rolling, row_blocks,
    row_texts, shard_count, sketch_rows, sliding, text_blocks,
)

WINDOW = 20
GRAM = 6
ROWS = 2  # hash rows of the sketch
FLUSH = 1_000_000  # candidate windows that a task holds at once
# place: the start in the upper 32 bits, the text's hash t in the lower ones
WINDOWS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("own", pa.binary())])
WINDOWS_DDL = "doc_id long, place long, h1 long, h2 long, own binary"


def _words(texts):
    """Words a text, and two independent 64-bit hashes of every word."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(words))), ">u8").reshape(-1, 2)
    return lengths, both[:, 1].astype(U64), both[:, 0].astype(U64)


def _minimizers(hashes: np.ndarray, lengths: np.ndarray, window: int):
    """Valid window starts, each one's least gram hash, and all gram hashes."""
    gram = min(GRAM, window)
    grams = mix64(rolling(hashes, gram))
    span = window - gram + 1
    least = sliding(grams, span, np.minimum) if len(grams) >= span else np.empty(0, U64)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(least)]
    valid = ends - np.arange(len(least)) >= window
    return valid, least, grams, span


def _chosen_grams(hashes, lengths, window):
    valid, least, grams, span = _minimizers(hashes, lengths, window)
    if not valid.any():
        return np.empty(0, U64)
    padded = np.zeros(len(grams) + span - 1, U64)
    padded[span - 1 : span - 1 + len(least)] = np.where(valid, least, U64(0))
    chosen = sliding(padded, span, np.maximum) == grams  # equal to the least of some window that covers it
    return grams[chosen]


def _cell(grams: np.ndarray, row: int) -> np.ndarray:
    return (mix64(grams + U64(1 + row)) >> U64(32)).astype(np.uint32)


def window_sketch(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """Partitions' sketch rows; those of hash row r have shards from r * shards on."""

    def build(batches):
        grams = []
        for _, raws in text_blocks(batches):
            lengths, hashes, _ = _words(raws)
            grams.append(_chosen_grams(hashes, lengths, window))
        for row in range(ROWS):
            for b in sketch_rows([_cell(g, row) for g in grams], shards):
                yield record(b.schema, pa.array(b.column(0).to_numpy() + np.int32(row * shards)), b.column(1))

    return texts.select("doc_id", "raw").mapInArrow(build, SKETCH_DDL)


def repeated_grams(texts: DataFrame, window: int) -> list[CellFilter]:
    """A filter a hash row; a gram whose least count is two or more passes them all."""
    shards = shard_count(texts.sparkSession)
    merged = materialize(merge_sketches(window_sketch(texts, window, shards)), "sketch")
    most = MAX_BITS - (ROWS - 1).bit_length()  # all rows together broadcast no more than one filter may
    found = []
    for row in range(ROWS):
        own = merged.filter(f"shard >= {row * shards} and shard < {(row + 1) * shards}")
        found.append(CellFilter(own.select((F.col("shard") - row * shards).alias("shard"), "cells"), most=most))
    discard(merged)
    return found


def repeated_windows(texts: DataFrame, cells: list[CellFilter], window: int) -> DataFrame:
    """Candidate windows: a task's first of each digest to be grouped, and what it can already remove (own)."""
    masks = [c.probe() for c in cells]

    def place(t, pos):
        return (np.asarray(pos, np.int64) << 32) | (t.astype(np.int64) & 0xFFFFFFFF)

    def settle(parts):
        ids, ts, h1, h2, pos = map(np.concatenate, zip(*parts))
        order = np.lexsort((ts, pos, ids, h2, h1))
        ids, ts, h1, h2, pos = ids[order], ts[order], h1[order], h2[order], pos[order]
        first = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (ids != ids[lead]) | (pos != pos[lead])  # the same place of a repeated row isn't later
        keep = np.flatnonzero(first | (~later & (ts != np.roll(ts, 1))))
        for i in range(0, len(keep), 50_000):
            k = keep[i : i + 50_000]
            yield record(WINDOWS, pa.array(ids[k]), pa.array(place(ts[k], pos[k])), pa.array(h1[k]), pa.array(h2[k]), pa.nulls(len(k), pa.binary()))
        ids, ts, pos = ids[later], ts[later], pos[later]
        order = np.lexsort((pos, ts, ids))
        ids, ts, pos = ids[order], ts[order], pos[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), bool), (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1]))))
        ends = np.append(starts[1:], len(ids))
        for i in range(0, len(starts), 5_000):
            s, e = starts[i : i + 5_000], ends[i : i + 5_000]
            none = pa.nulls(len(s), pa.int64())
            yield record(WINDOWS, pa.array(ids[s]), pa.array(place(ts[s], 0)), none, none, [pos[a:b].tobytes() for a, b in zip(s, e)])

    def emit(batches):
        parts, held = [], 0
        for keys, raws in row_blocks(batches):
            lengths, hashes, others = _words(raws)
            valid, least, _, _ = _minimizers(hashes, lengths, window)
            at = np.flatnonzero(valid)
            for row, mask in enumerate(masks):
                at = at[mask(_cell(least[at], row))]
            if not len(at):
                continue
            doc = np.searchsorted(np.cumsum(lengths), at, side="right")
            pos = (at - (np.cumsum(lengths) - lengths)[doc]).astype(np.int32)
            h1, h2 = (mix64(rolling(h, window)[at]).view(np.int64) for h in (hashes, others))
            parts.append((keys[doc, 0], keys[doc, 1].astype(np.int32), h1, h2, pos))
            held += len(at)
            if held >= FLUSH:
                yield from settle(parts)
                parts, held = [], 0
        if parts:
            yield from settle(parts)

    return texts.mapInArrow(emit, WINDOWS_DDL)


def removal_starts(windows: DataFrame) -> DataFrame:
    """doc_id, t, starts: the starts of windows that also start earlier, of each document that has any."""
    windows = windows.withColumn("t", F.expr("cast(shiftright(shiftleft(place, 32), 32) as int)"))
    whole = windows.filter("own is null").select("h1", "h2", "doc_id", "place")
    # at most a row per digest, task and flush, so no digest gathers many rows
    first = F.min(F.struct("doc_id", "place")).over(Window.partitionBy("h1", "h2"))
    later = whole.withColumn("first", first).filter("doc_id > first.doc_id or shiftright(place, 32) > shiftright(first.place, 32)")
    later = later.select("doc_id", F.expr("cast(shiftright(shiftleft(place, 32), 32) as int)").alias("t"), F.expr("cast(shiftright(place, 32) as int)").alias("pos"))
    own = windows.filter("own is not null").select("doc_id", "t", F.lit(None).cast("int").alias("pos"), "own")
    marks = later.withColumn("own", F.lit(None).cast("binary")).unionByName(own)
    return marks.groupBy("doc_id", "t").agg(F.collect_list("pos").alias("places"), F.collect_list("own").alias("own"))


def keep_mask(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) == 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, carry: tuple = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by one space), text (kept, or
    the input's text where nothing is removed), and the columns named in carry."""
    texts = row_texts(docs)
    marks = removal_starts(repeated_windows(texts, repeated_grams(texts, window), window))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("text", pa.binary())])
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b"")).alias("raw"), *carry).withColumn("t", F.hash("raw"))
    whole = bool(carry)

    def apply(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for at in range(0, b.num_rows, 500):
                out = ([], [], [], [], [])
                part = [cols[n].slice(at, 500) for n in ("doc_id", "raw", "places", "own")]
                for doc_id, raw, places, own in zip(part[0].to_pylist(), part[1].to_pylist(), part[2], part[3].to_pylist()):
                    words = raw.split()
                    n = len(words)
                    starts = [] if not places.is_valid else [places.values.to_numpy().astype(np.int64)]
                    starts += [np.frombuffer(x, np.int32).astype(np.int64) for x in own or ()]
                    starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
                    starts = starts[starts + window <= n]
                    if len(starts):
                        keep = keep_mask(n, starts, window)
                        words = [words[i] for i in np.flatnonzero(keep)]
                    kept = b" ".join(words)
                    for o, v in zip(out, (doc_id, n, n - len(words), kept, (raw if len(words) == n else kept) if whole else None)):
                        o.append(v)
                rest = [cols[c].slice(at, 500) for c in carry]
                yield pa.RecordBatch.from_arrays([*record(schema, *out).columns, *rest], names=[*schema.names, *carry])

    found = carried.filter("doc_id is not null").join(marks, ["doc_id", "t"], "left").select("doc_id", "raw", "places", "own", *carry)
    kinds = "".join(f", `{c}` {carried.schema[c].dataType.simpleString()}" for c in carry)
    result = found.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept binary, text binary" + kinds)
    return result.withColumn("kept", F.decode("kept", "UTF-8")).withColumn("text", F.decode("text", "UTF-8"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s,
  count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM x),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS nth FROM k WHERE n = 20),
g AS (SELECT DISTINCT doc_id, pos + d AS pos FROM f, range(20) t(d) WHERE nth > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM x ANTI JOIN g USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def brute_force(rows, window: int = WINDOW):
    """Reference answer for tests: (doc_id, text) rows with distinct ids."""
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        starts = []
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                starts.append(i)
            seen.add(key)
        keep = [w for i, w in enumerate(words) if not any(s <= i < s + window for s in starts)]
        out.append((doc_id, len(words), len(words) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()))
    return out
