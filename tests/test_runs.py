"""Anchors, experiment runs, extraction statistics and versions of a stream."""

import json

import pytest
from litspark.operators import anchors, explore, extract, report
from litspark.sources.writers import load_manifest
from litspark.streaming import incremental
from pyspark.sql import functions as F


def test_anchor_entry_and_numbering(spark):
    e = spark.createDataFrame([(1, " alpha ; ;beta;"), (2, None), (3, "gamma")], "n int, entry string")
    a = anchors.parse(e, order="n")
    assert [(r.pos, r.anchor_id, r.text, r.weight) for r in a.orderBy("pos").collect()] == [(1, "Q1", "alpha", 1.0), (2, "Q2", "beta", 1.0), (3, "Q3", "gamma", 1.0)]
    more = anchors.add(a, "delta", "d", 2.0)
    assert [(r.anchor_id, r.text) for r in more.orderBy("pos").collect()][-1] == ("Q4", "delta")
    less = anchors.remove(more, "Q2")
    assert [(r.anchor_id, r.text) for r in less.orderBy("pos").collect()] == [("Q1", "alpha"), ("Q2", "gamma"), ("Q3", "delta")]
    assert anchors.remove(less, "Q9").count() == 3
    back = anchors.from_rows(spark, [{"text": "x"}, {"text": "y", "description": "z", "weight": 3}])
    assert [(r.anchor_id, r.description, r.weight) for r in back.collect()] == [("Q1", "", 1.0), ("Q2", "z", 3.0)]
    assert anchors.parse(spark.createDataFrame([(" ; ",)], "entry string")).collect() == []


def test_experiment_runs(spark, tmp_path):
    seg = spark.createDataFrame([("a", "p1", "valid_paragraph", None), ("a", "p2", "invalid_segment", "short"), ("b", "p3", "valid_paragraph", None), ("b", "p4", None, None)], "article_id string, paragraph_id string, status string, exclusion_reason string")
    res = spark.createDataFrame([("p1", 0.9, True, 1, {"Q1": 0.9, "Q2": 0.12346}), ("p3", 0.1, False, 2, {"Q1": 0.1, "Q2": None})], "paragraph_id string, aggregate_score double, selected boolean, rank int, anchor_scores map<string,double>")
    who = [{"id": "Q1", "text": "first, \"quoted\"", "weight": 1.0}, {"id": "Q2", "text": "second", "weight": 2.0}]
    run = report.run_id()
    m = report.save_experiment(spark, str(tmp_path), run, {"threshold": 0.5}, seg, res, who, {"spark": spark.version}, {"f1": 0.5}, {"processing_time_seconds": 2})
    assert (m["total_articles"], m["total_paragraphs"], m["valid_paragraphs"], m["excluded_paragraphs"], m["selected_paragraphs"]) == (2, 4, 2, 2, 1)
    assert m["exclusion_reasons"].get("short") == 1 and m["processing_time_seconds"] == 2.0
    back, rows = report.load_experiment(spark, str(tmp_path), run)
    assert back == json.loads(json.dumps(m)) and sorted(rows.columns) == sorted(["paragraph_id", "aggregate_score", "selected", "rank", "Similarity_Q1", "Similarity_Q2"])
    assert rows.filter("rank = 1").first().Similarity_Q2 == 0.1235
    assert spark.read.option("header", "true").csv(f"{tmp_path}/{run}/results_csv").count() == 2
    assert load_manifest(spark, f"{tmp_path}/{run}/metrics") == {"f1": 0.5}
    assert "Q2: second" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/{run}/METHODS.md").collect())
    with pytest.raises(FileExistsError):
        report.save_experiment(spark, str(tmp_path), run, {}, seg, res, who)
    with pytest.raises(FileNotFoundError):
        report.load_experiment(spark, str(tmp_path), "exp_none")


def test_extraction_statistics_are_saved(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta", '{"evidence": ["alpha", "gone"], "concepts": ["c"]}'), (2, "gamma", '{"evidence": ["gamma"]}'), (3, "x", "{broken"), (4, "y", None)], "id int, text string, raw string")
    results = extract.parse(df).withColumn("evidence_valid", extract.evidence_valid(F.col("text"), F.col("evidence")))
    stats = extract.save_statistics(results, str(tmp_path / "stats"), "run", "mock", 10, 1.5)
    assert load_manifest(spark, str(tmp_path / "stats")) == json.loads(json.dumps(stats))
    assert (stats["processed_paragraphs"], stats["total_evidences_evaluated"], stats["valid_evidences_count"], stats["paragraphs_with_valid_evidence"]) == (4, 3, 2, 1)
    assert (stats["json_valid_count"], stats["evidence_validation_rate_evr"], stats["paragraph_validation_rate_pvr"], stats["rpm_configured"]) == (2, 66.67, 25.0, 10)
    assert extract.save_statistics(results.limit(0), str(tmp_path / "none"), "run", "mock") == {} and not (tmp_path / "none").exists()


def test_cached_rows_are_not_asked_again(spark):
    """One join brings cached answers; the provider sees only the others."""
    docs = extract.keyed(spark.createDataFrame([(i, f"text {i % 3}") for i in range(6)], "id int, text string"), "m", "v", "{}")
    cache = extract.extract(docs.filter("id = 0"), extract.mock_provider)

    def only_new(text):
        assert text != "text 0"
        return extract.mock_provider(text)

    out = extract.extract(docs, only_new, cache=cache)
    assert out.count() == 6 and out.filter("raw is null").count() == 0
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_stream_versions_have_their_own_pointers(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    with pytest.raises(FileNotFoundError):
        incremental.current(spark, target)
    for i, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 2), ("b", 1)]]):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_stream(spark, source, "k string, v int", ["k"], target, checkpoint)
        assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("pointer-")]) == i + 1
    assert sorted(map(tuple, incremental.current(spark, target).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    spark.createDataFrame([("z", 9)], "k string, v int").write.parquet(f"{target}/v7")  # a version whose pointer was never written
    assert incremental.current(spark, target).count() == 3


def test_cooccurrence_of_units_in_several_rows(spark):
    rows = [("a", 1, "water climate soil"), ("a", 2, "climate forest"), ("b", 3, "forest water"), ("c", 4, None)]
    df = spark.createDataFrame(rows, "article_id string, paragraph_id int, text string")
    got = {(r.a, r.b): r.weight for r in explore.cooccurrence(df, "document", 30, 1).collect()}
    assert got[("forest", "water")] == 2 and got[("climate", "soil")] == 1 and got[("climate", "forest")] == 1
    lines = {(r.a, r.b): r.weight for r in explore.cooccurrence(df, "paragraph", 30, 1).collect()}
    assert lines[("forest", "water")] == 1 and ("forest", "soil") not in lines
    assert {r.term: r.weight for r in explore.cooccurrence_nodes(df, "document").collect()}["climate"] == 1
    plan = explore.cooccurrence(df, "paragraph", 30, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1  # nothing but the edges is grouped
    assert explore.cooccurrence(df.filter("text is null"), "paragraph").collect() == []
