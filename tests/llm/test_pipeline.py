import random

import pytest
from litspark.llm import ngram_jaccard, substring_dedup
from litspark.llm.mixing import ORACLE_SQL as MIX_SQL

pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choices(vocab, k=60))
    rows = []
    for i in range(60):
        words = " ".join(rng.choices(vocab, k=rng.randint(30, 120)))
        if i % 6 == 0:
            words += " " + passage
        if i % 7 == 3:
            words = rows[-1][1] + " end"
        rows.append((i, words, "en", "abc"[i % 3], len(words)))
    return [*rows, (100, None, None, None, None), (101, "", "en", "a", 0)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        at[name] = docs.collect()
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == list(pipeline.COLUMNS)
    texts = {r.doc_id: r.text for r in at["quality classifier"]}
    assert len(texts) == len(rows)  # nothing to learn from: all stay
    stay = {d for d, _, c in ngram_jaccard.brute_force(sorted(texts.items())) if d == c}
    assert {r.doc_id for r in at["n-gram Jaccard join"]} == stay and len(stay) < len(texts)
    removed = {r[0]: r for r in substring_dedup.brute_force([(d, texts[d]) for d in stay])}
    import hashlib

    for r in at["substring dedup"]:
        _, n, gone, sha = removed[r.doc_id]
        assert r.text == texts[r.doc_id] if not gone else hashlib.sha256(r.text.encode()).hexdigest() == sha
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in at["substring dedup"]])
    want = {d: (2 * taken + size) // (2 * size) for d, size, _, _, taken, *_ in con.execute(MIX_SQL).fetchall() if taken}
    got = {}
    for r in at["mixing sources"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: t for d, t in want.items() if t}
    assert len(at["BPE encoding"]) == sum(got.values())
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, at["BPE encoding"]))


def test_quality_stage_with_labels(spark):
    """On the given tables the classifier learns: good documents stay whole, most bad ones go."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.quality_classifier(spark, docs, sf)
    assert kept.columns == list(pipeline.COLUMNS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = labels.join(kept.select("doc_id", F.lit(1).alias("stays")), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count("stays").alias("stay")).collect()
    by = {r.quality: r for r in rows}
    assert by[1].stay >= 0.98 * by[1].n and by[0].stay <= 0.05 * by[0].n
    assert kept.join(docs, list(pipeline.COLUMNS), "left_anti").count() == 0  # what stays is unchanged


def test_extra_and_clashing_columns(spark, tmp_path):
    """Columns of the stages' own names in the documents change nothing."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    more = df.selectExpr("*", "1 as size", "2 as taken", "3 as component_id", "4 as raw", "5 as score", "6 as n_words", "7 as nth")
    for name, stage in pipeline.STAGES[:4]:
        a, b = (sorted(map(tuple, stage(spark, d, str(tmp_path)).collect()), key=repr) for d in (df, more))
        assert a == b, name


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_of_repeated_ids(spark):
    rows = [(1, "a b " * 300, "en", "a", 1_200), (2, "c d " * 5, "en", "b", 20), (2, "e f " * 300, "en", "a", 1_200), (2, "g h " * 300, "en", "a", 1_200), (2, "i j k " * 5, "en", None, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = [(r.doc_id, r.source, r["size"], (2 * r.taken + r["size"]) // (2 * r["size"])) for r in pipeline.mixing.mix(docs).collect()]
    want = sorted(str(k[:3]) for k in taken for _ in range(k[3]))
    out = sorted(map(tuple, pipeline.source_mixing(spark, docs, "").collect()), key=str)
    assert sorted(str((d, s, len(t.split()))) for d, t, _, s, _ in out) == want
    assert len({k[3] for k in taken if k[0] == 2}) > 1  # the repeated rows differ in what is taken of them
    assert sorted(map(tuple, pipeline.source_mixing(spark, docs.repartition(3).orderBy(pipeline.F.desc("text")), "").collect()), key=str) == out
