"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the bytes before each place decides where a text is cut, so equal passages of different documents
are cut alike, into chunks of some sixteen words.  A first pass counts the chunks of all documents in a sketch; in the
second, a chunk that the sketch says is shared is encoded once per worker process and its ids are used for every document
there, while other chunks are encoded from their words.  Most cuts lie before white space: chunks joined there agree with
the whole text by construction, as the tokenizer drops white space and never looks across it.  A few cuts lie inside
words, so that a text without white space is cut too; such a join is repaired: the words that touch it are re-encoded as
one, after the chunks' own ids are checked to end and begin with those of the parts; while they don't agree, the repair
widens to both chunks.

Results: a null or empty text has no ids and decodes to the empty string; a text without white space is encoded whole;
repeated rows repeat their answers; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import (
    SKETCH_DDL, U64, CellFilter, discard, doc_texts, keep_in_process, materialize, merge_sketches, mix64, record, rolling, shard_count,
    sketch_rows, text_blocks,
)
from .token_cache import process_cache, read_tokenizer

HASHED = 4  # bytes under the rolling hash
EDGES = 16  # one in so many places before white space is cut
CHUNKS = 50_000  # shared chunks that a process keeps; a full table starts anew
WORDS = 500_000  # words that a process keeps
MARKS = ("^", "~", "|")  # symbols that may part words in one call of the tokenizer
INSIDE = 4096  # one in so many places inside words is cut
TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut before, and whether each lies inside a word (not before white space)."""
    if len(data) <= HASHED:
        return np.empty(0, np.int64), np.empty(0, bool)
    h = mix64(rolling(TABLE[data], HASHED))[:-1]  # of the bytes before place HASHED, HASHED + 1, ...
    here, before = data[HASHED:], data[HASHED - 1 : -1]
    edge = BLANK[here] & ~BLANK[before] & (h % U64(EDGES) == 0)
    inside = ~BLANK[here] & ~BLANK[before] & (here & 0xC0 != 0x80) & (h % U64(INSIDE) == 0)
    at = np.flatnonzero(edge | inside)
    return at + HASHED, inside[at]


def chunk(raws: list[bytes]):
    """Chunks of each text and the indices of chunks that begin inside a word."""
    out = []
    for raw in raws:
        at, inside = cuts(np.frombuffer(raw, np.uint8))
        edges = [0, *at.tolist(), len(raw)]
        out.append(([raw[x:y] for x, y in zip(edges, edges[1:])], (np.flatnonzero(inside) + 1).tolist()))
    return out


def chunk_cells(chunks: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, chunks), U64, len(chunks)) >> U64(32)).astype(np.uint32)


def shared_chunks(docs: DataFrame) -> CellFilter:
    """Passes every chunk that occurs more than once in all documents, and a few others."""
    shards = shard_count(docs.sparkSession)

    def build(batches):
        cells = [chunk_cells([c for chunks, _ in chunk(raws) for c in chunks]) for _, raws in text_blocks(batches)]
        yield from sketch_rows(cells, shards)

    merged = materialize(merge_sketches(doc_texts(docs).mapInArrow(build, SKETCH_DDL)), "sketch")
    found = CellFilter(merged)
    discard(merged)
    return found


def _tail(chunk: bytes) -> bytes:
    words = chunk.split()
    return words[-1] if words and not BLANK[chunk[-1]] else b""


def _head(chunk: bytes) -> bytes:
    words = chunk.split()
    return words[0] if words and not BLANK[chunk[0]] else b""


def _join(left: bytes, a: bytes, right: bytes, b: bytes, encode) -> bytes:
    """Ids of left + right from their ids a and b."""
    tail, head = _tail(left), _head(right)
    ends, begins, both = encode(tail), encode(head), encode(tail + head)
    if a.endswith(ends) and b.startswith(begins):
        return a[: len(a) - len(ends)] + both + b[len(begins) :]
    return encode(left + right)


def _caseless(tokenizer) -> bool:
    return tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"


def _joining(tokenizer) -> dict:
    """New words are encoded many at a time, parted by a symbol of one id."""
    alone = [m for m in MARKS if len(tokenizer.encode(m, add_special_tokens=False).ids) == 1]
    return {"separator": alone[0] if alone else None, "caseless": _caseless(tokenizer), "limit": WORDS}


_chunks: dict = keep_in_process({})  # by tokenizer: this process's shared chunks


def encode_texts(raws: list[bytes], tokenizer_text: str, shared=None) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers; shared: from chunks' cells whether to keep them."""
    words = process_cache(tokenizer_text, "words", make=_joining)
    kept = _chunks.setdefault(hash(tokenizer_text), {})
    texts = chunk(raws)
    flat = [c for chunks, _ in texts for c in chunks]
    keep = shared(chunk_cells(flat)).tolist() if shared else [False] * len(flat)
    ids = [kept.get(c) if k else None for c, k in zip(flat, keep)]
    holes = [i for i, x in enumerate(ids) if x is None]
    for i, x in zip(holes, words.values([flat[i].split() for i in holes])):
        ids[i] = b"".join(x)
        if keep[i]:
            if len(kept) >= CHUNKS:
                kept.clear()
            kept[flat[i]] = ids[i]
    encode = lambda piece: words.encode([piece])[0]
    out, at = [], 0
    for chunks, inside in texts:
        values, at = ids[at : at + len(chunks)], at + len(chunks)
        if not inside:
            out.append(b"".join(values))
            continue
        done, starts = [], set(inside)
        for i, (c, x) in enumerate(zip(chunks, values)):
            if i in starts:
                left, a = done.pop()
                done.append((left + c, _join(left, a, c, x, encode)))
            else:
                done.append((c, x))
        out.append(b"".join(x[1] for x in done))
    return out


# ---------------------------------------------------------------- steps over Arrow batches, and their DataFrame operators
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([*IDS, ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS_DDL, DECODED_DDL = "doc_id long, ids binary", "doc_id long, ids binary, decoded string"
DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_batches(batches, tokenizer_text: str, shared: CellFilter):
    mask = shared.probe()
    for ids, raws in text_blocks(batches, caches=True):
        yield record(IDS, ids, encode_texts(raws, tokenizer_text, mask))


def decode_table(tokenizer) -> list[str]:
    """Each id's token; this tokenizer has no decoder, so decode() joins tokens by spaces."""
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return [tokenizer.id_to_token(i) or "" for i in range(size)]


def decode_batches(batches, tokenizer_text: str):
    tok = process_cache(tokenizer_text, "words", make=_joining).tokenizer
    table = None if tok.decoder is not None else decode_table(tok)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            ids, raws = b.column(0).slice(at, 500), b.column(1).slice(at, 500)
            lists = [np.frombuffer(r, "<u4").tolist() for r in raws.to_pylist()]
            if table is None:
                texts = tok.decode_batch(lists, skip_special_tokens=False)
            else:
                texts = [" ".join(map(table.__getitem__, x)) for x in lists]
            yield record(DECODED, ids, raws, texts)


def digest_batches(batches):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    decimal = [str(i) for i in range(1 << 16)]
    for b in batches:
        for at in range(0, b.num_rows, 500):
            lists = [np.frombuffer(r, "<u4").tolist() for r in b.column(1).slice(at, 500).to_pylist()]
            while max(map(max, filter(None, lists)), default=0) >= len(decimal):
                decimal += [str(i) for i in range(len(decimal), 2 * len(decimal))]
            texts = b.column(2).slice(at, 500).cast(pa.binary()).to_pylist()
            yield record(DIGESTS, b.column(0).slice(at, 500), [len(x) for x in lists], [sha(" ".join(map(decimal.__getitem__, x)).encode()) for x in lists], [sha(t) for t in texts])


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (little-endian unsigned 32-bit integers)."""
    tokenizer, shared = read_tokenizer(docs.sparkSession, tokenizer_path), shared_chunks(docs)
    return doc_texts(docs).mapInArrow(lambda batches: encode_batches(batches, tokenizer.value, shared), IDS_DDL)


def decode_documents(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """coded (doc_id, ids) -> doc_id, ids, decoded (as the library's decode with skip_special_tokens=False)."""
    tokenizer = read_tokenizer(coded.sparkSession, tokenizer_path)
    return coded.select("doc_id", "ids").mapInArrow(lambda batches: decode_batches(batches, tokenizer.value), DECODED_DDL)


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256."""
    return decoded.select("doc_id", "ids", "decoded").mapInArrow(digest_batches, DIGESTS_DDL)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """digest(decode_documents(encode_documents(docs))) in one Python pass: one worker and one cache per task."""
    tokenizer, shared = read_tokenizer(docs.sparkSession, tokenizer_path), shared_chunks(docs)

    def run(batches):
        yield from digest_batches(decode_batches(encode_batches(batches, tokenizer.value, shared), tokenizer.value))

    return doc_texts(docs).mapInArrow(run, DIGESTS_DDL)
