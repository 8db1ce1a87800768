import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from litspark.llm import tiff


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.text("ab", max_size=3000).map(str.encode)))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_over_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data)) == data
    # the format's own example: 7 7 7 8 8 7 7 6 6
    assert tiff.unlzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("how", list(tiff.ENCODERS))
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(how, tile, order, predictor):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 9, shape).astype(np.uint8) for shape in ((1, 1), (70, 33), (16, 32))]
    media = tiff.write_tiff(pages, how, predictor, 7, tile, order)
    got = [tiff.read_page(media, o, t) for o, t in tiff.directories(media)]
    assert len(got) == 3 and all((a == b[..., 0]).all() for a, b in zip(pages, got))


def test_float_predictor_and_wide_samples():
    values = np.linspace(-3, 7, 24, dtype=">f4").reshape(2, 12)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(2, 12, 4).transpose(0, 2, 1).reshape(2, 48)
    raw = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
    assert (tiff._rows(raw, 2, 12, 1, np.dtype("<f4"), 3)[..., 0] == values).all()
    wide = np.arange(24, dtype="<u2").reshape(2, 4, 3) * 3000
    raw = np.diff(wide, axis=1, prepend=np.zeros((2, 1, 3), "<u2")).tobytes()
    assert (tiff._rows(raw, 2, 4, 3, np.dtype("<u2"), 2) == wide).all()


def test_damaged_media():
    good = tiff.store_text(b"x" * 5000, 8)
    assert [r[4] for r in tiff.media_pages(1, 0, good)] == [0, 1, 2, 3]
    for bad in (None, b"", b"II*\0", b"nonsense", good[:-40], good[:60], struct.pack("<4sI", b"II*\0", 8) + b"\1\0" + b"\0" * 12 + struct.pack("<I", 8)):
        rows = tiff.media_pages(1, 0, bad)
        assert rows[-1][4] is None and rows[-1][5] and rows[-1][-1]


def test_texts(spark):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (5, "long " * 60_000), (6, "x" * 193), (4, "x" * 193)]
    df = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, media string").repartition(3)
    got = sorted(tuple(r)[:7] for r in tiff.digest(tiff.decode_pages(tiff.store_texts(df))).collect())
    want = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = tiff.store_text(raw)
        want.append((doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest()))
    assert got == sorted(want)
    assert tiff.digest(tiff.decode_pages(tiff.store_texts(df.limit(0)))).count() == 0


def test_pages_after_a_damaged_one_are_read():
    pages = [np.full((2, 8), v, np.uint8) for v in (1, 2, 3)]
    media = bytearray(tiff.write_tiff(pages))
    at = next(t for i, (_, t) in enumerate(tiff.directories(bytes(media))) if i == 1)
    offset = next(v for k, v in at.items() if "offset" in str(k).lower())[0]
    media[offset : offset + 4] = b"\xff" * 4
    rows = tiff.media_pages(1, 0, bytes(media))
    assert [(r[4], r[9]) for r in rows] == [(0, pages[0].tobytes()), (2, pages[2].tobytes()), (None, None)] and rows[-1][5] and rows[-1][-1]


def test_impossible_dimensions_are_an_error_row():
    """Sizes that no data could fill, no samples and bombs end in the error row, without allocating them."""
    import struct as st

    def directory(fields):
        return b"II*\0" + st.pack("<IH", 8, len(fields)) + b"".join(st.pack("<HHII", t, 4, 1, v) for t, v in sorted(fields.items())) + st.pack("<I", 0)

    base = {256: 192, 257: 1, 258: 8, 259: 1, 273: 8, 277: 1, 279: 4}
    for change in ({256: 4_000_000_000, 257: 1_000_000}, {277: 0, 284: 2}, {258: 64, 256: 1 << 30}):
        (row,) = tiff.media_pages(1, 4, directory({**base, **change}))
        assert row[4] is None and row[-1] == "dimensions beyond the data"
    assert len(tiff._decode(__import__("zlib").compress(b"x" * 50_000_000), tiff.DEFLATE)) == 50_000_000


def test_bytes_made_elsewhere():
    """Examples of the formats' descriptions, and a whole big-endian file put together by hand."""
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + "AA" * 10)
    file = bytes.fromhex(
        "4D4D002A0000000C" "FE07 0001"  # order, 42, directory at 12; PackBits: three 7s; padding
        "0009" "01000003000000010003 0000" "01010003000000010001 0000" "01020003000000010008 0000" "01030003000000018005 0000" "01060003000000010001 0000"
        "01110004000000010000 0008" "01150003000000010001 0000" "01160003000000010001 0000" "01170004000000010000 0002" "00000000"
    )
    ((_, _, _, _, page, last, width, height, channels, samples, error),) = tiff.media_pages(1, 3, file)
    assert (page, last, width, height, channels, bytes(samples), error) == (0, True, 3, 1, 1, bytes([7, 7, 7]), None)


def test_every_way_of_storing_is_used():
    """By content: over some texts each codec, predictor, byte order and layout occurs, and all come back."""
    seen = set()
    for i in range(120):
        raw = f"text {i} ".encode() * (1 + i * 20)
        media, how = tiff.store_text(raw), tiff.layout(tiff.payload(raw))
        seen |= set(how.items())
        rows = tiff.media_pages(1, len(raw), media)
        assert b"".join(r[9] for r in rows) == tiff.payload(raw) and rows[-1][-1] is None
        assert media == tiff.store_text(raw)
    assert seen == {("compression", c) for c in tiff.STORED} | {("predictor", 1), ("predictor", 2), ("order", "<"), ("order", ">"), ("tiled", True), ("tiled", False)}


def test_feature(spark):
    df = spark.createDataFrame([(1, "ab" * 96), (2, "x" * 192 * 1025)], "doc_id long, text string")
    got = {r.doc_id: r.feature for r in tiff.digest(tiff.decode_pages(tiff.store_texts(df))).collect()}
    assert got == {1: "pages=1;rows=1;mean=97.5000;entropy=1.0000", 2: "pages=2;rows=1025;mean=120.0000;entropy=-0.0000"} or got[2].startswith("pages=2;rows=1025;mean=120.0000;entropy=")
    bad = tiff.digest(tiff.decode_pages(spark.createDataFrame([(3, 5, bytearray(b"II*"))], "doc_id long, n_bytes long, media binary"))).first()
    assert bad.payload_bytes == 0 and ";error=" in bad.feature


def test_rows_out_of_order_are_an_error(spark):
    df = spark.createDataFrame([(i, "long " * 90_000) for i in range(3)], "doc_id long, text string").coalesce(1)
    pages = tiff.decode_pages(tiff.store_texts(df))
    assert pages.count() == 9
    with pytest.raises(Exception, match="follow each other"):
        tiff.digest(pages.orderBy("page", "doc_id").coalesce(1)).collect()
    with pytest.raises(Exception, match="follow each other"):
        tiff.digest(pages.filter("not last")).collect()
