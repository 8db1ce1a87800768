"""Archives as a data source."""

import io
import os
import tracemalloc
import zipfile

import pytest
from litspark.sources import archives as A
from litspark.sources import readers
from pyspark.sql import functions as F


def write(path, members, compression=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", compression) as z:
        for name, content in members:
            z.writestr(name, content)
    return str(path)


MEMBERS = [("a.pdf", b"one"), ("sub/B.PDF", b"two" * 1000), ("empty.pdf", b""), ("note.txt", b"x"), ("__MACOSX/a.pdf", b"x"), ("sub/.hidden.pdf", b"x"), ("../out.pdf", b"x"), ("/abs.pdf", b"x")]


def test_members_and_rules(spark, tmp_path):
    path = write(tmp_path / "x.zip", MEMBERS)
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 nothing")
    (tmp_path / "other.dat").write_bytes(b"no archive")
    rows = A.read_archives(spark, str(tmp_path)).collect()
    good = {r.member: bytes(r.content) for r in rows if r.error is None}
    assert good == {"a.pdf": b"one", "sub/B.PDF": b"two" * 1000, "empty.pdf": b""}
    assert {(os.path.basename(r.archive), r.member, r.error.split(":")[0]) for r in rows if r.error} == {("x.zip", "../out.pdf", "unsafe path"), ("x.zip", "/abs.pdf", "unsafe path"), ("broken.zip", None, "not an archive")}
    with pytest.raises(readers.UnsafeArchive):
        readers.require_safe(A.read_archives(spark, path))
    assert {r.member for r in A.read_archives(spark, f"{tmp_path}/x*.zip", suffixes=".txt").filter("error is null").collect()} == {"note.txt"}
    assert A.read_archives(spark, path, maxMemberBytes=100).filter("error = 'too large'").first().member == "sub/B.PDF"
    with pytest.raises(Exception, match="FileNotFound|missing"):
        A.read_archives(spark, str(tmp_path / "missing.zip")).collect()


def test_large_archive_is_cut_and_streamed(spark, tmp_path):
    """Members of one archive go to several partitions and come in pieces that make them whole again."""
    blobs = {f"m{i:02d}.pdf": os.urandom(300_000 + i) for i in range(12)}
    path = write(tmp_path / "big.zip", blobs.items(), zipfile.ZIP_STORED)
    df = A.read_archives(spark, path, partitionBytes=700_000, chunkBytes=65_536)
    assert df.rdd.getNumPartitions() == 6
    assert df.agg(F.max(F.length("content"))).first()[0] == 65_536 and df.filter("last").count() == 12
    whole = {r.member: bytes(r.content) for r in A.whole_members(df).collect()}
    assert whole == blobs
    assert A.whole_members(df, most=1000).filter("error = 'too large' and content is null").count() == 12


def test_memory_stays_at_a_piece(tmp_path):
    """A member of 200 MB in an archive passes with a few MB held."""
    path = write(tmp_path / "wide.zip", [("w.pdf", bytes(200 << 20))])
    reader = A.ArchiveReader({"path": path, "chunkBytes": str(1 << 20)})
    tracemalloc.start()
    total = sum(len(b.column(5)[0].as_py()) for p in reader.partitions() for b in reader.read(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 200 << 20 and peak < 16 << 20


def test_damaged_member_is_its_own_error(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.pdf", b"A" * 5000)
        z.writestr("b.pdf", b"B" * 5000)
    raw = bytearray(buffer.getvalue())
    raw[raw.index(b"AAAA") + 100] ^= 1
    (tmp_path / "d.zip").write_bytes(raw)
    rows = {r.member: r for r in A.whole_members(A.read_archives(spark, str(tmp_path / "d.zip"), chunkBytes=512)).collect()}
    assert rows["a.pdf"].content is None and rows["a.pdf"].error.startswith("damaged") and bytes(rows["b.pdf"].content) == b"B" * 5000


def test_members_to_pages(spark, tmp_path):
    """Archive to pages: the reader of the format is a parameter."""
    path = write(tmp_path / "x.zip", [("a.pdf", b"p1\fp2"), ("b.pdf", b"")])
    files = A.whole_members(A.read_archives(spark, path)).filter("error is null").select(F.col("member").alias("path"), "content")
    pages = {r.path: r for r in readers.read_pages(files, lambda c: c.decode().split("\f")).collect()}
    assert [p.text for p in pages["a.pdf"].pages] == ["p1", "p2"] and pages["b.pdf"].error == "no text"
