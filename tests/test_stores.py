"""Audited versions, registry look-ups and index archives."""

import io
import re
import zipfile

import pytest
from litspark.operators import audit, index, index_archive, ivf, registry_store
from pyspark.sql import functions as F

DDL = "annotation_id string, paragraph_id string, labels array<int>, note string"
V1 = [("a", "p1", [1], None), ("b", "p2", [2, 3], "n"), ("c", "p3", [], "")]
V2 = [("a", "p1", [1], None), ("b", "p2", [2], "n"), ("d", "p4", [5], None)]


def rows_of(df):
    return sorted(map(tuple, df.select("annotation_id", "paragraph_id", "labels", "note").collect()))


# ---------------------------------------------------------------- audit
def test_log_and_replay(spark, tmp_path):
    path, frame = str(tmp_path / "ann"), lambda rows: spark.createDataFrame(rows, DDL)
    assert audit.versions(spark, path) == []
    assert audit.save(frame(V1), path, ["annotation_id"], "ann", "2024-01-01 00:00:00")["counts"] == {"insert": 3}
    assert audit.save(frame(V2), path, ["annotation_id"], "bob", "2024-01-02 00:00:00", "adjudicate")["counts"] == {"update": 1, "delete": 1, "insert": 1}
    third = audit.merge(frame([("c", "p3", [4], "back"), ("a", "p1", [1], None)]), path, ["annotation_id"], "ann", "2024-01-03 00:00:00")
    assert third["counts"] == {"insert": 1}  # an equal row is no change
    for version, want in ((1, V1), (2, V2)):
        assert rows_of(audit.current(spark, path, version)) == rows_of(audit.replay(spark, path, version)) == sorted(want)
    assert rows_of(audit.replay(spark, path)) == rows_of(audit.current(spark, path)) and audit.current(spark, path).count() == 4
    log = {(r.version, r.annotation_id): r for r in audit.audit_log(spark, path).collect()}
    assert log[2, "b"].before.labels == [2, 3] and log[2, "b"].after.labels == [2] and (log[2, "b"].author, log[2, "b"].action) == ("bob", "adjudicate")
    assert log[2, "c"].after is None and log[3, "c"].before is None and len(log) == 7


def test_audit_refuses_and_hides_half_versions(spark, tmp_path):
    path, frame = str(tmp_path / "ann"), lambda rows: spark.createDataFrame(rows, DDL)
    with pytest.raises(ValueError):
        audit.save(frame([*V1, V1[0]]), path, ["annotation_id"], "a", "2024-01-01")
    audit.save(frame(V1), path, ["annotation_id"], "a", "2024-01-01")
    frame(V2).write.parquet(f"{path}/data-000002")  # a writer that died before its manifest
    assert rows_of(audit.current(spark, path)) == sorted(V1)
    audit.save(frame(V2), path, ["annotation_id"], "a", "2024-01-02")
    assert rows_of(audit.replay(spark, path)) == sorted(V2)
    with pytest.raises(FileNotFoundError):
        audit.current(spark, path, 9)


def test_changes_with_null_and_composite_keys(spark):
    a = spark.createDataFrame([(1, None, "x"), (1, "k", "y")], "i int, k string, v string")
    b = spark.createDataFrame([(1, None, "z"), (2, "k", None)], "i int, k string, v string")
    got = sorted((r.i, r.k or "", r.op) for r in audit.changes(a, b, ["i", "k"]).collect())
    assert got == [(1, "", "update"), (1, "k", "delete"), (2, "k", "insert")]
    assert audit.changes(a, a, ["i", "k"]).count() == 0


# ---------------------------------------------------------------- registry
def scanned(df):
    """Rows that the scan handed on, from the plan's own metrics."""
    df.collect()
    node, out = df._jdf.queryExecution().executedPlan(), []
    stack = [node.executedPlan() if "AdaptiveSparkPlan" in node.getClass().getName() else node]
    while stack:
        n = stack.pop()
        if "FileSourceScanExec" in n.getClass().getName():
            out.append((n.metrics().apply("numOutputRows").value(), n.metrics().apply("numFiles").value()))
        kids = n.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return out[0]


def test_point_look_ups(spark, tmp_path):
    reg = spark.range(4000).select(F.format_string("art-%d", "id").alias("article_id"), F.sha2(F.col("id").cast("string"), 256).alias("pdf_sha256"), F.format_string("f%d.pdf", (F.col("id") / 2).cast("int")).alias("source_filename"))
    odd = spark.createDataFrame([("x", None, "only-name.pdf"), ("y", "0" * 64, None)], "article_id string, pdf_sha256 string, source_filename string")
    path = str(tmp_path / "reg")
    registry_store.save(reg.union(odd), path, 8)
    sha = reg.filter("article_id = 'art-77'").first().pdf_sha256
    hit = registry_store.find(spark, path, "pdf_sha256", [sha], 8)
    assert [r.article_id for r in hit.collect()] == ["art-77"]
    assert sorted(r.article_id for r in registry_store.find(spark, path, "source_filename", ["f5.pdf", "only-name.pdf"], 8).collect()) == ["art-10", "art-11", "x"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=) ", hit._jdf.queryExecution().toString())
    rows, files = scanned(registry_store.find(spark, path, "pdf_sha256", [sha], 8))
    assert files == 1 and rows < 1000  # one bucket of eight
    absent = registry_store.find(spark, path, "pdf_sha256", [sha[:-1] + ("0" if sha[-1] != "0" else "1")], 8)
    rows, files = scanned(absent)
    assert rows == 0 and files == 1  # every row group of the bucket's file was skipped, though the key lies in its range
    wanted = reg.filter("article_id in ('art-1', 'art-9')").select("pdf_sha256").union(spark.createDataFrame([(None,), ("no",)], "pdf_sha256 string"))
    assert sorted(r.article_id for r in registry_store.find_all(wanted, path, "pdf_sha256", 8).collect()) == ["art-1", "art-9"]
    with pytest.raises(ValueError):
        registry_store.find(spark, path, "pdf_sha256", [str(i) for i in range(11)], 8)


# ---------------------------------------------------------------- archives
def an_index(spark, path):
    rows = spark.range(300).select(F.col("id").alias("faiss_id"), F.concat(F.lit("a"), F.col("id") % 7).alias("article_id"), F.array(*((F.col("id") % k).cast("double") for k in (3, 5, 7))).alias("embedding"), (F.col("id") % 2 == 0).alias("class_1"))
    index.save(rows, path, {"model": "m"})
    return rows


def test_archive_round_trip(spark, tmp_path):
    path, zipped, back = str(tmp_path / "idx"), str(tmp_path / "idx.zip"), str(tmp_path / "back")
    rows = an_index(spark, path)
    sums = index_archive.write_archive(spark, path, zipped, rows.select("article_id"))
    with zipfile.ZipFile(zipped) as z:
        assert z.testzip() is None and set(z.namelist()) == {*sums, "index_report.md", "checksums.sha256"}
        report = z.read("index_report.md").decode()
    assert "- vectors: 300" in report and "| class_1 | 150 |" in report and "## Coverage" in report
    manifest = index_archive.read_archive(spark, zipped, back)
    assert manifest["n_vectors"] == 300
    assert sorted(index.load(spark, back)[0].collect()) == sorted(index.load(spark, path)[0].collect())
    with pytest.raises(FileExistsError):
        index_archive.read_archive(spark, zipped, back)


def test_archive_of_cells_and_nested_archive(spark, tmp_path):
    path, zipped, outer = str(tmp_path / "idx"), str(tmp_path / "idx.zip"), str(tmp_path / "outer.zip")
    ivf.build(an_index(spark, str(tmp_path / "plain")), path, cells=4)
    index_archive.write_archive(spark, path, zipped)
    with zipfile.ZipFile(outer, "w") as z:
        z.write(zipped, "deep/down/idx.zip")
        z.writestr("readme.txt", "x")
    index_archive.read_archive(spark, outer, str(tmp_path / "back"))
    idx = ivf.InvertedFile(spark, str(tmp_path / "back"), check=True)
    assert idx.rows.count() == 300 and len(idx.cells) <= 4


def rewrite(zipped, change):
    """The archive's members after a change of a name -> bytes dict."""
    with zipfile.ZipFile(zipped) as z:
        members = {n: z.read(n) for n in z.namelist()}
    change(members)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, c in members.items():
            z.writestr(n, c)
    return buffer.getvalue()


def test_damaged_and_missing_parts(spark, tmp_path):
    path, zipped = str(tmp_path / "idx"), str(tmp_path / "idx.zip")
    an_index(spark, path)
    sums = index_archive.write_archive(spark, path, zipped)
    part = next(n for n in sums if n.startswith("data-"))

    def damaged(m):
        m[part] = m[part][:-20] + bytes(20)

    cases = [(damaged, ValueError), (lambda m: m.pop(part), FileNotFoundError), (lambda m: m.pop("checksums.sha256"), FileNotFoundError), (lambda m: m.update({"../evil": b"x"}), ValueError)]
    for i, (change, error) in enumerate(cases):
        (tmp_path / f"bad{i}.zip").write_bytes(rewrite(zipped, change))
        with pytest.raises(error):
            index_archive.read_archive(spark, str(tmp_path / f"bad{i}.zip"), str(tmp_path / f"back{i}"))
        assert not (tmp_path / f"back{i}").exists() and not (tmp_path / "evil").exists()
    (tmp_path / "cut.zip").write_bytes((tmp_path / "idx.zip").read_bytes()[:500])
    with pytest.raises((ValueError, FileNotFoundError)):
        index_archive.read_archive(spark, str(tmp_path / "cut.zip"), str(tmp_path / "back"))
    assert [p.name for p in tmp_path.iterdir() if "part-" in p.name] == []
