"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id; each partition writes one file of ids (unsigned 16-bit if the
vocabulary allows, else 32-bit, little-endian) and one of offsets: int64 doc_ids, then uint64 starts and the end.  The
manifest has each file's counts; its prefix sums are the partitions' bases.  Files are read through memory maps.  A
file is written under a name of its own attempt and only the committed manifest names it, so a lost executor's rerun
never mixes with a dead attempt.

Texts are encoded piece by piece: a byte-level pre-tokenizer never joins a non-space character with a single space after
it, so pieces start at such spaces and equal pieces share one encoding.

Results: a null text is empty and holds the end id only; rows repeating a doc_id follow each other; an empty table gives
an empty manifest.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, materialize, n_parts, new_path, record, text_blocks
from .token_cache import process_cache, read_tokenizer

# bytes that may touch a space as further white space; texts without them are cut by a plain split
RARE = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
RARE_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf")
SPACE_MARK = "\u0120"  # fixed value: how byte-level vocabularies write a space
SPACE = "\\s\u180e\u200b-\u200f\u2060\ufeff"
JOIN = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def pieces(raw: bytes) -> list[bytes]:
    """The text cut before single spaces between other characters, without those spaces."""
    if any(r in raw for r in RARE) or not raw.isascii() and any(r in raw for r in RARE_WIDE):
        return [p.encode() for p in JOIN.split(raw.decode())]
    return raw.split(b" ")


def _joining(tokenizer, width: int) -> dict:
    """Pieces are joined by the space before each, which only a piece's first id can hold."""
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    starts = np.fromiter((tokenizer.id_to_token(i).startswith(SPACE_MARK) for i in range(size)), bool, size)
    return {"prefix": " ", "starts": starts, "width": width}


def encode_texts(raws: list[bytes], tokenizer_text: str, width: int = 4) -> list[bytes]:
    """Ids of each text, as little-endian unsigned integers of width bytes."""
    cut = [pieces(r) for r in raws]
    heads = process_cache(tokenizer_text, f"head{width}", width=width).values([[c[0]] for c in cut])
    tails = process_cache(tokenizer_text, f"tail{width}", make=lambda t: _joining(t, width)).values([c[1:] for c in cut])
    return [b"".join([*h, *t]) for h, t in zip(heads, tails)]


MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])
MANIFEST_DDL = "part long, path string, n_docs long, n_tokens long, width int"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, name: str = "tokens") -> DataFrame:
    """Write the id files; returns the manifest part, path, n_docs, n_tokens, width, base (ids in the parts before)."""
    spark = docs.sparkSession
    tokenizer = read_tokenizer(spark, tokenizer_path)
    from .token_cache import load_tokenizer

    width = 2 if max(load_tokenizer(tokenizer.value).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    folder = new_path(spark, name)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        ids, sizes = [], []
        end = np.array([end_id], f"<u{width}").tobytes()
        with files.open_output_stream(path + ".ids") as out:
            for doc_ids, raws in text_blocks(batches, 4_000_000, caches=True):
                coded = encode_texts(raws, tokenizer.value, width)
                ids += doc_ids
                sizes += [len(c) // width + 1 for c in coded]
                out.write(end.join(coded) + end)
        if ids:
            starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
            with files.open_output_stream(path + ".off") as out:
                out.write(np.array(ids, "<i8").tobytes() + starts.tobytes())
            yield record(MANIFEST, [part], [f"{folder}/{path.rpartition('/')[2]}"], [len(ids)], [int(starts[-1])], [width])
        else:
            files.delete_file(path + ".ids")

    rows = doc_texts(docs).repartitionByRange(n_parts(spark), "doc_id").sortWithinPartitions("doc_id", "raw")
    manifest = materialize(rows.mapInArrow(write, MANIFEST_DDL), name + "-manifest")
    # one row per file, not per document
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))


def _map(uri: str, dtype: str) -> np.ndarray:
    files, path = fs.FileSystem.from_uri(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if files.get_file_info(path).size else np.empty(0, dtype)
    with files.open_input_file(path) as f:  # a store without memory maps
        return np.frombuffer(f.read(), dtype)


def open_part(path: str, n_docs: int, width: int):
    """doc_ids, starts (with the end) and ids of one part."""
    off = _map(path + ".off", "<i8")
    return off[:n_docs], off[n_docs:].view("<u8"), _map(path + ".ids", f"<u{width}")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (over all files), n_tokens, ids_crc32 (of the ids as uint32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for path, n_docs, width, base in zip(*(b.column(i).to_pylist() for i in range(4))):
                doc_ids, starts, ids = open_part(path, n_docs, width)
                starts = starts.astype(np.int64)
                for at in range(0, n_docs, 10_000):
                    cut = starts[at : at + 10_001].tolist()
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut, cut[1:])]
                    s = starts[at : at + len(crc)]
                    yield record(schema, pa.array(np.array(doc_ids[at : at + len(crc)])), pa.array(s + base), pa.array(np.diff(starts[at : at + len(crc) + 1])), crc)

    rows = manifest.select("path", "n_docs", "width", "base")
    rows = rows.repartition(n_parts(manifest.sparkSession), "path")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
