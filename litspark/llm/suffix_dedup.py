"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts anywhere else.

Equal strings must meet in one shard, so each 200-byte string is dealt by the least hashed 64-byte gram inside it, and
consecutive strings with the same gram travel as one segment.  A merged sketch counts those grams and a sample of all
32-byte grams, chosen by their own hash: a repeated string holds none that is counted once, and only strings that hold
none are dealt.  A shard holds its distinct segments with their numbers of occurrences, sorts their
concatenation by induced sorting and reads repeats off the permuted common prefixes; the marks go back to the documents
by the segments' 128-bit digests.

Equal segments are sorted once more, as a pair, so that the array finds them too.

Results: strings are judged on the input, overlaps count, matches never cross documents.  A null text is empty; a text
under 200 bytes keeps all; a repeated row is a copy like any other, so both lose their bytes; rows
of one doc_id with different texts each lose bytes of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BASE, SKETCH_DDL, U64, CellFilter, discard, materialize, merge_sketches, mix64, n_parts, record, rolling, row_blocks,
    row_texts, run_starts, shard_count, sketch_rows, sliding, text_blocks,
)
from .suffix_array import capped_plcp, suffix_array

LENGTH = 200
GRAM = 64
SAMPLE = 32  # bytes of the sampled grams, of which one in so many is counted
SHARD_BYTES = 1_000_000  # text sorted at once
TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
SEGMENTS = pa.schema(
    [("doc_id", pa.int64()), ("t", pa.int32()), ("start", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]
)
SEGMENTS_DDL = "doc_id long, t int, start long, d1 long, d2 long, key long, n long, bytes binary"


def _strings(texts, length, level=0):
    """Concatenated bytes, text lengths, valid string starts, their least grams, all grams, and the sampled places with
    their grams; each level has a hash of its own."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    gram, small = min(GRAM, length), min(SAMPLE, length)
    span = length - gram + 1
    h = TABLE[data]
    part = rolling(h, small)
    n = len(part) - small
    grams = part[:n] * U64(pow(BASE, small, 1 << 64)) + part[small:] if gram == 2 * small and n > 0 else rolling(h, gram)
    grams ^= grams >> U64(32)
    grams *= U64(0x94D049BB133111EB)
    if level:
        grams = mix64(grams + U64(level))
    least = sliding(grams, span, np.minimum) if len(grams) >= span else np.empty(0, U64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    valid = ends[: len(least)] - np.arange(len(least)) >= length
    if level:
        return lengths, valid, least, grams, span, None, None
    part *= U64(0xBF58476D1CE4E5B9)
    places = np.flatnonzero((part >> U64(40)) % U64(SAMPLE) == 0)
    places = places[ends[places] - places >= small]
    return lengths, valid, least, grams, span, places, part[places]


def _cell(grams, kind=1):
    return (mix64(grams + U64(kind)) >> U64(32)).astype(np.uint32)


def gram_sketch(texts: DataFrame, length: int, shards: int) -> DataFrame:
    def build(batches):
        cells = []
        for _, raws in text_blocks(batches, 1_000_000):
            _, valid, least, grams, span, _, sampled = _strings(raws, length)
            cells.append(_cell(sampled, 2))
            if valid.any():
                least[~valid] = 0
                padded = np.zeros(len(grams) + span - 1, U64)
                padded[span - 1 : span - 1 + len(least)] = least
                cells.append(_cell(grams[sliding(padded, span, np.maximum) == grams]))
        yield from sketch_rows(cells, shards)

    return texts.select("doc_id", "raw").mapInArrow(build, SKETCH_DDL)


def segments(texts: DataFrame, cells: CellFilter, length: int) -> DataFrame:
    """Occurrences (doc_id, start, digest) of candidate segments, and each partition's distinct segments (digest, key,
    number of occurrences n, bytes)."""
    mask = cells.probe()

    def emit(batches):
        distinct: dict[bytes, list] = {}
        for row_keys, raws in row_blocks(batches, 1_000_000):
            lengths, valid, least, _, _, places, sampled = _strings(raws, length)
            once = np.zeros(int(lengths.sum()) + 1, np.int32)
            once[places[~mask(_cell(sampled, 2))] + 1] = 1
            np.cumsum(once, out=once)
            reach = length - min(SAMPLE, length) + 1
            valid &= once[reach : reach + len(valid)] == once[: len(valid)]
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            value = least[at]
            doc = np.searchsorted(np.cumsum(lengths), at, side="right")
            first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1))))
            size = np.diff(np.append(first, len(at)))
            hot = mask(_cell(value[first]))
            first, size = first[hot], size[hot]
            offsets = np.cumsum(lengths) - lengths
            docs, keys = doc[first], value[first].view(np.int64)
            starts = at[first] - offsets[docs]
            digests = []
            for d, p, n, key in zip(docs.tolist(), starts.tolist(), size.tolist(), keys.tolist()):
                part = raws[d][p : p + n + length - 1]
                digest = xxhash.xxh3_128_digest(part)
                digests.append(digest)
                known = distinct.get(digest)
                if known is None:
                    distinct[digest] = [key, 1, part]
                else:
                    known[1] += 1
            if digests:
                pair = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                none = pa.nulls(len(pair), pa.int64())
                yield record(SEGMENTS, pa.array(row_keys[docs, 0]), pa.array(row_keys[docs, 1].astype(np.int32)), pa.array(starts), pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none, pa.nulls(len(pair), pa.binary()))
        items = list(distinct.items())
        for i in range(0, len(items), 5_000):
            part = items[i : i + 5_000]
            pair = np.frombuffer(b"".join(x[0] for x in part), ">i8").astype(np.int64).reshape(-1, 2)
            none = pa.nulls(len(part), pa.int64())
            yield record(SEGMENTS, none, pa.nulls(len(part), pa.int32()), none, pa.array(pair[:, 0]), pa.array(pair[:, 1]), [x[1][0] for x in part], [x[1][1] for x in part], [x[1][2] for x in part])

    return texts.mapInArrow(emit, SEGMENTS_DDL)


def shard_repeats(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that also start elsewhere in the shard: the segment, and the run's first and last start in
    it."""
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + 1
    symbols[starts + lengths - 1] = 0  # separators, below every byte
    phi, plcp = capped_plcp(data, suffix_array(symbols), length)
    room = np.repeat(starts + lengths - 1, lengths) - np.arange(len(data)) >= length
    twin = np.flatnonzero((plcp >= length) & room)
    twin = twin[room[phi[twin]]]
    found = np.zeros(len(data) + 2, np.int8)  # a separator's place is never found, so runs end with their segment
    found[twin + 1] = 1
    found[phi[twin] + 1] = 1
    edge = np.diff(found)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    part = np.searchsorted(starts, first, side="right") - 1
    return part, first - starts[part], last - starts[part]


MARKS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("runs", pa.binary())])


def _split(segs: list[tuple[bytes, int, int]], length: int, level: int):
    """Cut a key's segments (bytes, owner, offset) by the least gram under another level's hash: equal strings meet in
    the same part, and a gram in very many texts no longer gathers them all."""
    parts: dict[int, list] = {}
    lengths, valid, least, *_ = _strings([x[0] for x in segs], length, level)
    at = np.flatnonzero(valid)
    doc = np.repeat(np.arange(len(segs)), lengths - length + 1)
    value = least[at]
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))))
    size = np.diff(np.append(first, len(at)))
    starts = at[first] - (np.cumsum(lengths) - lengths)[doc[first]]
    for d, p, n, v in zip(doc[first].tolist(), starts.tolist(), size.tolist(), value[first].tolist()):
        raw, owner, offset = segs[d]
        parts.setdefault(v, []).append((raw[p : p + n + length - 1], owner, offset + p))
    return list(parts.values())


LEVELS = 12


def _batches(groups: list[list], length: int, limit: int):
    """Lists of segments of whole keys, of about limit bytes; a larger key is cut by further grams."""
    todo, batch, size = [(g, 0) for g in groups], [], 0
    while todo:
        group, level = todo.pop()
        n = sum(len(x[0]) for x in group)
        if n > limit and level < LEVELS and len(group) > 1:
            parts = _split(group, length, level + 1)
            if len(parts) > 1:
                todo += [(p, level + 1) for p in parts]
                continue
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch += group
        size += n
    if batch:
        yield batch


def shard_marks(found: DataFrame, length: int) -> DataFrame:
    """d1, d2, runs: the repeated string starts of each distinct segment, as (first, last) pairs of 32-bit integers."""
    limit = SHARD_BYTES

    def sort(batches):
        keys: dict[int, dict] = {}
        for b in batches:
            for d1, d2, key, n, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                known = keys.setdefault(key, {}).setdefault((d1, d2), [raw, 0])
                known[1] += n
        digests, groups, out = [], [], []
        for segs in keys.values():
            group = []
            for digest, (raw, n) in segs.items():
                # equal segments are sorted as two: the array finds their strings twice, however many there are
                group += [(raw, len(digests), 0)] * min(n, 2)
                digests.append(digest)
            groups.append(group)
        del keys
        for batch in _batches(groups, length, limit):
            part, first, last = shard_repeats([x[0] for x in batch], length)
            owner, offset = (np.array([x[i] for x in batch], np.int64)[part] for i in (1, 2))
            out.append(np.stack([owner, first + offset, last + offset], 1))
        runs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)
        begin = run_starts(runs[:, 0])
        pairs = np.ascontiguousarray(runs[:, 1:].astype(np.int32))
        rows = [(*digests[runs[x, 0]], pairs[x:y].tobytes()) for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(runs)])]
        for i in range(0, len(rows), 5_000):
            yield record(MARKS, *zip(*rows[i : i + 5_000]))

    rows = found.filter("key is not null").select("d1", "d2", "key", "n", "bytes")
    return rows.repartition(n_parts(found.sparkSession), "key").mapInArrow(sort, "d1 long, d2 long, runs binary")


def dedup_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (bytes left)."""
    texts, spark = row_texts(docs), docs.sparkSession
    merged = materialize(merge_sketches(gram_sketch(texts, length, shard_count(spark))), "sketch")
    cells = CellFilter(merged)
    discard(merged)
    found = materialize(segments(texts, cells, length), "segments")
    places = found.filter("key is null").select("doc_id", "t", "start", "d1", "d2")
    marks = (
        places.join(shard_marks(found, length), ["d1", "d2"])
        .groupBy("doc_id", "t")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("runs").alias("runs"))
    )
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def apply(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for at in range(0, b.num_rows, 500):
                out = ([], [], [], [], [])
                part = [cols[n].slice(at, 500).to_pylist() for n in ("doc_id", "raw", "starts", "runs")]
                for doc_id, raw, starts, runs in zip(*part):
                    n, spans, kept = len(raw), 0, raw
                    if starts:
                        pairs = [np.frombuffer(r, np.int32).astype(np.int64).reshape(-1, 2) for r in runs]
                        lo = np.concatenate([p[:, 0] + s for p, s in zip(pairs, starts)])
                        hi = np.concatenate([p[:, 1] + s for p, s in zip(pairs, starts)]) + length
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, np.minimum(lo, n), 1)
                        np.add.at(edge, np.minimum(hi, n), -1)
                        gone = np.cumsum(edge[:n]) > 0
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    for o, v in zip(out, (doc_id, n, n - len(kept), spans, kept)):
                        o.append(v)
                yield record(schema, *out)

    joined = texts.join(marks, ["doc_id", "t"], "left").select("doc_id", "raw", "starts", "runs")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows, length: int = LENGTH):
    """Reference answer for tests."""
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
