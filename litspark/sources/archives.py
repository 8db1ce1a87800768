"""ZIP archives as a source: ``spark.read.format("archive").load(path)`` after ``register(spark)``.

One row a piece of a member: archive, member, place (in the archive's directory), size, part (from 0), content, last, error.
Planning reads directories only.  A large archive is cut into partitions of neighbouring members, small ones share a
partition; a task streams its members in pieces of ``chunkBytes``, so neither an archive nor a member has to fit into memory.

Options: path (a file, a folder or a pattern in its last part; several separated by ``|``), suffixes (``.pdf``; separated by
commas, ``*`` for all), partitionBytes (64 MB, compressed), chunkBytes (4 MB), maxMemberBytes (0: any size).

Folders, hidden files and resource forks are left out.  What can't be read is a row with an error and no content: an
archive that is none (member null), a member whose path leaves the archive, an encrypted one, one larger than
maxMemberBytes and one whose data are damaged (its earlier pieces may be there, which ``whole_members`` leaves out).  Paths are
those of pyarrow's file systems: local and shared folders, and the object stores that it supports; each executor opens
the files itself.
"""

from __future__ import annotations

import fnmatch
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, place int, size long, part int, content binary, last boolean, error string"
ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int32()), ("size", pa.int64()), ("part", pa.int32()), ("content", pa.binary()), ("last", pa.bool_()), ("error", pa.string())])


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(path)
    else:
        fs = pafs.LocalFileSystem()
    return fs, path


def list_archives(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives that a path, a folder or a pattern names, sorted."""
    out = []
    for one in path.split("|"):
        scheme = one[: one.index("://") + 3] if "://" in one else ""
        fs, inner = _open(one)
        folder, _, last = inner.rpartition("/")
        if any(c in last for c in "*?["):
            found = [i for i in fs.get_file_info(pafs.FileSelector(folder or ".")) if fnmatch.fnmatch(i.base_name, last)]
        else:
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(one)
            found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(inner)) if i.base_name.lower().endswith(".zip")]
        out += [(scheme + i.path, i.size) for i in found if i.type == pafs.FileType.File]
    return sorted(set(out))


def member_name(info: zipfile.ZipInfo, suffixes: tuple[str, ...]) -> tuple[str, str | None] | None:
    """Name and error of a member that counts, else None."""
    name = info.filename.replace("\\", "/")
    parts = name.split("/")
    if info.is_dir() or "__MACOSX" in parts or (parts[-1].startswith(".") and parts[-1] != ".."):
        return None
    if ".." in parts or name.startswith("/") or (len(name) > 1 and name[1] == ":"):
        return name, "unsafe path"
    if "*" not in suffixes and not name.lower().endswith(suffixes):
        return None
    return name, "encrypted" if info.flag_bits & 1 else None


@dataclass
class Members(InputPartition):
    """Stretches (archive, first place, end) of archives' directories; end -1: all."""

    stretches: list


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        number = lambda name, default: int(options.get(name.lower(), default))
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the archive source needs a path")
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ".pdf").split(","))
        self.partition_bytes, self.chunk, self.most = number("partitionBytes", 64 << 20), number("chunkBytes", 4 << 20), number("maxMemberBytes", 0)

    def partitions(self) -> list[Members]:
        out, some, size = [], [], 0
        for archive, n in list_archives(self.path):
            if n <= self.partition_bytes:
                stretches = [((archive, 0, -1), n)]
            else:
                stretches = self._cut(archive)
            for stretch, n in stretches:
                if some and size + n > self.partition_bytes:
                    out.append(Members(some))
                    some, size = [], 0
                some.append(stretch)
                size += n
        return [*out, Members(some)] if some else out or [Members([])]

    def _cut(self, archive: str) -> list[tuple[tuple, int]]:
        try:
            fs, inner = _open(archive)
            with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                sizes = [i.compress_size for i in z.infolist()]
        except (zipfile.BadZipFile, pa.ArrowInvalid, OSError):
            return [((archive, 0, -1), 0)]  # its reader tells
        out, start, size = [], 0, 0
        for i, n in enumerate(sizes):
            if i > start and size + n > self.partition_bytes:
                out.append(((archive, start, i), size))
                start, size = i, 0
            size += n
        return [*out, ((archive, start, len(sizes)), size)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        for archive, start, end in partition.stretches:
            row = lambda member, place, size, part, content, last, error: pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((archive, member, place, size, part, content, last, error), ARROW)], schema=ARROW  # noqa: B023
            )
            try:
                fs, inner = _open(archive)
                with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    infos = z.infolist()
                    for place in range(start, len(infos) if end < 0 else end):
                        found = member_name(infos[place], self.suffixes)
                        if found is not None:
                            yield from self._member(z, infos[place], place, *found, row)
            except (zipfile.BadZipFile, pa.ArrowInvalid, OSError) as e:
                yield row(None, None, None, None, None, True, f"not an archive: {e}")

    def _member(self, z, info, place, name, error, row):
        if error is None and self.most and info.file_size > self.most:
            error = "too large"
        if error is not None:
            yield row(name, place, info.file_size, None, None, True, error)
            return
        part, left = 0, info.file_size
        try:
            with z.open(info) as member:
                while True:
                    content = member.read(self.chunk)
                    left -= len(content)
                    if left <= 0 and content and member.read(1):  # also checks the sum at the end
                        raise zipfile.BadZipFile("longer than its directory says")
                    if content or not part:
                        yield row(name, place, info.file_size, part, content, left <= 0, None)
                    part += 1
                    if left <= 0 or not content:
                        break
            if left > 0:
                raise zipfile.BadZipFile("shorter than its directory says")
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
            yield row(name, place, info.file_size, None, None, True, f"damaged: {e}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("archive")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def whole_members(pieces: DataFrame, most: int = 256 << 20) -> DataFrame:
    """archive, member, content, error: one row a member.  A member with an error has no content; one of more than ``most``
    bytes is an error, too, as a row holds it whole."""
    rows = pieces.withColumn("content", F.when(F.col("size") <= most, F.col("content"))).withColumn("error", F.when(F.col("size") > most, "too large").otherwise(F.col("error")))
    out = rows.groupBy("archive", "member", "place").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("part", "content")))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.content))
    return out.select("archive", "member", F.when(F.col("error").isNull(), whole).alias("content"), "error")
