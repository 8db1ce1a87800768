"""Media columns: TIFF encoding and decoding.

The decoder walks the image file directories of a classic TIFF (either byte order), decodes strips or tiles that are
plain, PackBits, LZW or deflate, undoes the horizontal and floating-point predictors and emits one row per page.  The
encoder stores bytes losslessly as 8-bit grey samples, a page of at most ``page_rows`` rows at a time.

Results: a null or empty medium has one row with the error "empty" and no page; a damaged one has its readable pages,
then one row with a null page and the error; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts, record, text_blocks

ROW = 192  # samples a row of stored payloads
PAGE_ROWS = 1024
# fixed values of the format: tags, compressions and the sizes of field types
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "sample_format": 339}
NAMES = {v: k for k, v in TAGS.items()}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}


RATIO = 3000  # a compressed byte holds fewer: deflate at most 1032, LZW under 2800


class TiffError(ValueError):
    """The bytes are not a TIFF that can be read."""


# ---------------------------------------------------------------- codecs
def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += 2 + c
        else:
            if c > 128:
                out.append(data[i + 1 : i + 2] * (257 - c))
                i += 1
            i += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as repeats, what lies between them as literals, 128 bytes at a time."""
    x, out, done = np.frombuffer(data, np.uint8), bytearray(), 0
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(x))
    long = ends - starts >= 3
    for start, end in (*zip(starts[long].tolist(), ends[long].tolist()), (len(x), len(x))):
        for i in range(done, start, 128):
            literal = data[i : min(i + 128, start)]
            out.append(len(literal) - 1)
            out += literal
        for i in range(start, end, 128):
            n = min(128, end - i)
            out += bytes((257 - n, data[i])) if n > 1 else bytes((0, data[i]))
        done = end
    return bytes(out)


CLEAR, END = 256, 257  # LZW codes


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(single), 9, 0, 0, None, []
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        while bits >= width:
            bits -= width
            code = held >> bits & ((1 << width) - 1)
            if code == END:
                return b"".join(out)
            if code == CLEAR:
                table, width, last = list(single), 9, None
                continue
            if last is None:
                entry = table[code] if code < len(table) else b""
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise TiffError("bad LZW code")
                table.append(last + entry[:1])
                if len(table) + 1 >= 1 << width and width < 12:
                    width += 1
            out.append(entry)
            last = entry
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code):
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    fresh = {bytes((i,)): i for i in range(256)}
    table, size, word = dict(fresh), 258, b""
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            put(CLEAR)
            table, size, width = dict(fresh), 258, 9
        elif size + 1 > 1 << width:
            width += 1
        word = bytes((b,))
    if word:
        put(table[word])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _decode(data: bytes, how: int) -> bytes:
    if how == PLAIN:
        return data
    if how == PACKBITS:
        return unpack_bits(data)
    if how == LZW:
        return unlzw(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, RATIO * len(data) + 1024)  # no more than deflate can hold
    raise TiffError(f"compression {how}")


ENCODERS = {PLAIN: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1)}


def undo_predictor(block: np.ndarray, predictor: int, dtype: np.dtype) -> np.ndarray:
    """block: rows x columns x samples of dtype (for predictor 3: the rows' raw bytes)."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    return block


def _rows(raw: bytes, rows: int, columns: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    size = rows * columns * samples * dtype.itemsize
    if len(raw) < size:
        raise TiffError("short strip or tile")
    if predictor == 3:  # byte planes, most significant first, differenced over the row
        flat = np.frombuffer(raw[:size], np.uint8).reshape(rows, -1)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8) if samples == 1 else _strided_sum(flat, samples)
        planes = flat.reshape(rows, dtype.itemsize, columns * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">f{dtype.itemsize}").reshape(rows, columns, samples).astype(dtype)
    block = np.frombuffer(raw[:size], dtype).reshape(rows, columns, samples)
    return undo_predictor(block, predictor, dtype)


def _strided_sum(flat: np.ndarray, step: int) -> np.ndarray:
    return np.cumsum(flat.reshape(len(flat), -1, step), axis=1, dtype=np.uint8).reshape(len(flat), -1)


# ---------------------------------------------------------------- directories
def directories(media: bytes):
    """The tags of each page, in file order."""
    if len(media) < 8 or media[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("not a TIFF")
    order = "<" if media[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", media, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(media):
            raise TiffError("bad directory")
        seen.add(at)
        n = struct.unpack_from(order + "H", media, at)[0]
        if at + 6 + 12 * n > len(media):
            raise TiffError("bad directory")
        tags = {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", media, at + 2 + 12 * i)
            if tag in NAMES and kind in TYPES:
                width = struct.calcsize(TYPES[kind]) * count
                place = at + 10 + 12 * i
                if width > 4:
                    place = struct.unpack_from(order + "I", media, place)[0]
                if place + width > len(media):
                    raise TiffError("field beyond the end")
                tags[NAMES[tag]] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", media, place)
        yield order, tags
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def read_page(media: bytes, order: str, tags: dict) -> np.ndarray:
    """Rows x columns x samples."""
    one = lambda name, default=None: tags.get(name, (default,))[0]
    width, height, samples = one("width"), one("height"), one("samples", 1)
    bits, form, how, predictor = one("bits", 8), one("sample_format", 1), one("compression", PLAIN), one("predictor", 1)
    if not width or not height or bits not in (8, 16, 32, 64) or predictor not in (1, 2, 3):
        raise TiffError("unsupported page")
    if samples < 1 or width * height * samples * bits // 8 > RATIO * len(media):
        raise TiffError("dimensions beyond the data")
    dtype = np.dtype(("|" if bits == 8 else order) + {1: "u", 2: "i", 3: "f"}.get(form, "u") + str(bits // 8))
    planes = samples if one("planar", 1) == 2 else 1
    per = samples // planes
    out = np.empty((height, width, samples), dtype)
    tiled = "tile_offsets" in tags
    bw, bh = (one("tile_width"), one("tile_height")) if tiled else (width, min(height, one("rows_per_strip", height)))
    offsets, counts = (tags.get(k) for k in (("tile_offsets", "tile_counts") if tiled else ("strip_offsets", "strip_counts")))
    if not offsets or not counts or not bw or not bh:
        raise TiffError("no strips or tiles")
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) < across * down * planes:
        raise TiffError("missing strips or tiles")
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, height - y)
        block = _rows(_decode(media[offsets[k] : offsets[k] + counts[k]], how), rows, bw, per, dtype, predictor)
        h, w = min(rows, height - y), min(bw, width - x)
        out[y : y + h, x : x + w, plane * per : (plane + 1) * per] = block[:h, :w]
    return out


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: int = 0, order: str = "<") -> bytes:
    """8-bit grey pages (rows x columns) as a classic TIFF of strips, or of square tiles."""
    out = [b"II*\0" if order == "<" else b"MM\0*", b""]
    at = 8
    next_at = []
    for page in pages:
        height, width = page.shape
        if tile:
            spots = [(y, x) for y in range(0, height, tile) for x in range(0, width, tile)]
            blocks = [np.zeros((tile, tile), np.uint8) for _ in spots]
            for (y, x), b in zip(spots, blocks):
                part = page[y : y + tile, x : x + tile]
                b[: part.shape[0], : part.shape[1]] = part
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        if predictor == 2:
            blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
        coded = [ENCODERS[compression](b.tobytes()) for b in blocks]
        offsets = []
        for c in coded:
            offsets.append(at)
            out.append(c + b"\0" * (len(c) % 2))
            at += len(out[-1])
        counts = [len(c) for c in coded]
        fields = {"width": (4, [width]), "height": (4, [height]), "bits": (3, [8]), "compression": (3, [compression]), "photometric": (3, [1]), "samples": (3, [1]), "predictor": (3, [predictor])}
        if tile:
            fields |= {"tile_width": (4, [tile]), "tile_height": (4, [tile]), "tile_offsets": (4, offsets), "tile_counts": (4, counts)}
        else:
            fields |= {"rows_per_strip": (4, [rows_per_strip]), "strip_offsets": (4, offsets), "strip_counts": (4, counts)}
        entries = []
        for tag, kind, values in sorted((TAGS[k], *v) for k, v in fields.items()):
            packed = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                packed += b"\0" * (len(packed) % 2)
                out.append(packed)
                place = struct.pack(order + "I", at)
                at += len(packed)
            else:
                place = packed.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + place)
        next_at.append((len(out), at, order))
        out.append(struct.pack(order + "H", len(entries)) + b"".join(entries))
        at += len(out[-1]) + 4
        out.append(b"")
    links = [a for _, a, _ in next_at] + [0]
    out[1] = struct.pack(order + "I", links[0])
    for (i, _, _), link in zip(next_at, links[1:]):
        out[i + 1] = struct.pack(order + "I", link)
    return b"".join(out)


def payload(raw: bytes, row: int = ROW) -> bytes:
    """The bytes with spaces added up to a positive multiple of row."""
    return raw.ljust(max(1, -(-len(raw) // row)) * row, b" ")


STORED = (LZW, PACKBITS, PACKBITS, PLAIN, PLAIN, *[DEFLATE] * 11)  # sixteenths; LZW costs most, a table look-up a byte


def layout(data: bytes) -> dict:
    """How a payload is stored, by its hash: codec, predictor, byte order, and strips or tiles."""
    h = hashlib.sha256(data).digest()
    return {"compression": STORED[h[1] & 15], "predictor": 1 + (h[0] & 1), "order": "<>"[h[0] >> 1 & 1], "tiled": bool(h[0] >> 2 & 1)}


def store_text(raw: bytes, page_rows: int = PAGE_ROWS) -> bytes:
    """A text's payload as a TIFF.  Equal texts have equal media; together texts use every codec, predictor, byte order and
    layout that can store bytes."""
    data = payload(raw)
    samples, how = np.frombuffer(data, np.uint8).reshape(-1, ROW), layout(data)
    tile = 64 if how.pop("tiled") and len(samples) >= 64 else 0  # below, tiles would be mostly padding
    return write_tiff([samples[y : y + page_rows] for y in range(0, len(samples), page_rows)], tile=tile, **how)


# ---------------------------------------------------------------- DataFrame operators
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media (the text's payload as a TIFF)."""

    def run(batches):
        for ids, raws in text_blocks(batches):
            yield record(MEDIA, ids, [len(r) for r in raws], [store_text(r) for r in raws])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()),
     ("last", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("error", pa.string())]
)
PAGES_DDL = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, last boolean, width int, height int, channels int, samples binary, error string"


def media_pages(doc_id, n_bytes, media):
    """One tuple a page, in order; last marks a medium's last row."""
    head = (doc_id, n_bytes, len(media or b""), hashlib.sha256(media or b"").hexdigest())
    rows, error = [], None
    damage = (ValueError, struct.error, zlib.error, IndexError, TypeError, ArithmeticError, MemoryError)
    if not media:
        error = "empty"
    try:
        for page, (order, tags) in enumerate(directories(media) if media else ()):
            try:
                image = read_page(media, order, tags)
            except damage as e:  # the later pages are still read
                error = error or str(e) or "damaged"
                continue
            rows.append((*head, page, False, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None))
    except damage as e:
        error = error or str(e) or "damaged"
    if error or not rows:
        rows.append((*head, None, False, None, None, None, None, error or "no page"))
    rows[-1] = (*rows[-1][:5], True, *rows[-1][6:])
    return rows


def decode_pages(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) -> one row a page; a medium's rows follow each other in its partition."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = [b.column(i).slice(at, 100).to_pylist() for i in range(3)]
                rows = [row for medium in zip(*part) for row in media_pages(*medium)]
                yield record(PAGES, *zip(*rows))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PAGES_DDL)


def digest(pages: DataFrame) -> DataFrame:
    """Features of the payloads read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.  A medium's rows must follow each other by page, as decode_pages gives them; rows that don't,
    say after a shuffle, are an error."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        held, at, now = [], -1, None
        for b in batches:
            out = []
            for doc_id, n_bytes, media_bytes, sha, page, last, width, height, _, samples, error in zip(*(b.column(i).to_pylist() for i in range(11))):
                if held and doc_id != now or page is not None and page <= at:
                    raise ValueError(f"rows of medium {now if held else doc_id} don't follow each other")
                held.append(samples or b"")
                now, at = doc_id, at if page is None else page
                if last:
                    data = b"".join(held)
                    held, at = [], -1
                    x = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                    share = x[x > 0] / max(1, len(data))
                    bits = -float((share * np.log2(share)).sum()) if len(data) else 0.0
                    mean = float((x * np.arange(256)).sum()) / max(1, len(data))
                    feature = f"pages={(page if page is not None else -1) + 1};rows={len(data) // ROW};mean={mean:.4f};entropy={bits:.4f}"
                    feature += f";error={error}" if error else ""
                    out.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), media_bytes, sha, feature))
            if out:
                yield record(schema, *zip(*out))
        if held:
            raise ValueError(f"rows of medium {now} don't follow each other")

    return pages.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
