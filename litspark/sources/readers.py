"""Sources: documents, archives, tolerant JSON lines, forms, tables and encoders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class UnsafeArchive(ValueError):
    """A member's path leaves the archive."""


def find_inputs(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = "*.{pdf,PDF,zip,ZIP}") -> DataFrame:
    """path, length, sha256 of input files, sorted by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("pdf_sha256")).dropDuplicates(["path"]).orderBy("path")


def archive_members(files: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """files (path, content of ZIPs) -> archive, member, content of the documents inside, read in memory.  Folders,
    hidden files and resource forks are left out; a member that points outside has an error instead of content."""

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    out.append((path, None, None, "not an archive"))
                    continue
                for m in z.infolist():
                    name = m.filename.replace("\\", "/")
                    parts = name.split("/")
                    if m.is_dir() or parts[0] == "__MACOSX" or parts[-1].startswith(".") and parts[-1] != "..":
                        continue
                    if ".." in parts or name.startswith("/"):
                        out.append((path, name, None, "unsafe path"))
                    elif name.lower().endswith(suffix):
                        out.append((path, name, z.read(m), None))
            yield pd.DataFrame(out, columns=["archive", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "archive string, member string, content binary, error string")


def require_safe(members: DataFrame) -> DataFrame:
    bad = members.filter("error = 'unsafe path'").limit(1).collect()
    if bad:
        raise UnsafeArchive(f"{bad[0].archive}: {bad[0].member}")
    return members


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """files (path, content) -> path, pages array<struct<page,text>>, error.  The reader of the document format is a
    parameter; without one, a PDF library is used where it is installed."""

    def run(batches):
        read = reader or _pdf_reader()
        for b in batches:
            pages, errors = [], []
            for content in b.content:
                try:
                    texts = read(bytes(content))
                    pages.append([{"page": i, "text": t} for i, t in enumerate(texts, 1)])
                    errors.append(None if any(t.strip() for t in texts) else "no text" if texts else "no pages")
                except Exception as e:
                    pages.append([])
                    errors.append(str(e) or "unreadable")
            yield pd.DataFrame({"path": b.path, "pages": pages, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, pages array<struct<page:int,text:string>>, error string")


def _pdf_reader():
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; pass a reader") from e

    def read(content):
        with fitz.open(stream=content, filetype="pdf") as doc:
            if doc.needs_pass:
                raise ValueError("encrypted")
            return [page.get_text() for page in doc]

    return read


def joined_text(pages) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.text), "\n\n")


def markdown_files(spark: SparkSession, folder: str, exclude: tuple = ("README.md", "index_report.md")) -> DataFrame:
    """article_id (file stem), text of the Markdown files of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    rows = rows.filter(~F.col("name").isin(*exclude))
    return rows.select(F.regexp_replace("name", "\\.md$", "").alias("article_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad and blank lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def gold_file(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema("paragraph_id string, human_label int, annotator string, annotation_date string, notes string, article_id string, text_sha256 string").option("multiLine", multi_line).json(path)


def csv_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's table, if it has been written."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage_files(spark: SparkSession, root: str, stages: dict[str, list[str]]) -> list[tuple[str, str, bool]]:
    """(stage, artefact, present) of every artefact that the stages name."""
    return [(s, a, path_exists(spark, f"{root}/{a}")) for s, names in stages.items() for a in names]


def latest_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed JSON-lines registry: the last line of each article."""
    from ..operators.corpus import latest

    rows = json_lines(spark, path, schema)
    return latest(rows, ["article_id"], "version_number")


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""
    import zlib

    def encode(texts):
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def encode_texts(df: DataFrame, text: str = "text", make_encoder: Callable = hashing_encoder, batch: int = 32) -> DataFrame:
    """df with embedding: the encoder is made once per task and asked in batches; zero vectors stay zero."""

    @F.pandas_udf("array<float>")
    def encode(parts: pd.Series) -> pd.Series:
        enc = make_encoder()
        rows = [enc(list(parts.iloc[i : i + batch].fillna(""))) for i in range(0, len(parts), batch)]
        return pd.Series([r.tolist() for r in np.concatenate(rows)] if rows else [])

    return df.withColumn("embedding", encode(text))
