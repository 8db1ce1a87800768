"""Hand-computed values and edge cases of the library's operators."""

import io
import zipfile

import numpy as np
import pytest
from litspark.functions import labels as L
from litspark.functions import segment as S
from litspark.functions import text as T
from litspark.operators import annotate as A
from litspark.operators import classify, corpus, explore, extract, index, ingest, references, report, sampling, search
from litspark.operators import evaluate as E
from litspark.operators.project import Project
from litspark.sources import readers, writers
from litspark.streaming import incremental
from pyspark.sql import functions as F


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "given,want,vector",
    [([0], [0], [0] * 5), ([0, 2], [2], [0, 1, 0, 0, 0]), ([0, 1, 3, 5], [1, 3, 5], [1, 0, 1, 0, 1]), ([4, 2, 4], [2, 4], [0, 1, 0, 1, 0]), ([], [], [0] * 5)],
)
def test_label_rule(spark, given, want, vector):
    assert one(spark, L.sanitize(F.col("l")), l=("array<int>", given)) == want
    assert one(spark, L.to_vector(F.col("l")), l=("array<int>", given)) == vector
    assert one(spark, L.from_vector(F.col("v")), v=("array<int>", vector)) == ([c for c in want if c] or [0])


@pytest.mark.parametrize("strategy,want", [("maximum", 0.8), ("mean", 0.6), ("weighted_mean", 0.55), ("centroid", 0.75)])
def test_anchor_aggregation(spark, strategy, want):
    col = search.aggregate("s", strategy, [1.0, 3.0] if strategy == "weighted_mean" else [1.0, 1.0, 1.0], F.lit(0.75))
    s = [0.7, 0.5] if strategy == "weighted_mean" else [0.4, 0.6, 0.8]
    assert one(spark, col, s=("array<double>", s)) == pytest.approx(want)
    assert one(spark, search.aggregate("s", "weighted_mean", [0.0, 0.0]), s=("array<double>", [0.2, 0.4])) == pytest.approx(0.3)


def frame(spark, rng, n, d):
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i // 10, i, v.tolist(), "valid_paragraph") for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "article_id int, paragraph_id int, embedding array<float>, status string")


@pytest.mark.parametrize("m", [1, 5, 25])
def test_search_equals_naive_and_ignores_partitioning(spark, m):
    x, df = frame(spark, np.random.default_rng(m), 300, 32)
    anchors = spark.createDataFrame([(f"Q{i + 1}", i, 1.0, x[i * 7].tolist()) for i in range(m)], "anchor_id string, pos int, weight double, embedding array<float>")
    outs = [{r.paragraph_id: (r.aggregate_score, r["rank"]) for r in search.multi_anchor_search(df.repartition(p), anchors, threshold=0.5).collect()} for p in (1, 7)]
    assert outs[0] == outs[1]
    want = (x.astype(float) @ x[[i * 7 for i in range(m)]].astype(float).T).max(1)
    assert max(abs(outs[0][i][0] - want[i]) for i in range(300)) < 1e-5
    assert sorted(r for _, r in outs[0].values()) == list(range(1, 301))
    assert search.multi_anchor_search(df, anchors, threshold=-1, only_retained=True).count() == 300
    assert search.multi_anchor_search(df, anchors, threshold=0.99, only_retained=True).count() == m
    assert search.multi_anchor_search(df, anchors.limit(0)).count() == 0
    assert search.summary(search.multi_anchor_search(df.limit(0), anchors)).first().n_total == 0


def test_zero_vector_and_contexts(spark):
    df = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [3.0, 4.0])], "article_id int, paragraph_id int, embedding array<float>")
    anchors = spark.createDataFrame([("Q1", 0, 1.0, [3.0, 4.0])], "anchor_id string, pos int, weight double, embedding array<float>")
    got = {r.paragraph_id: r.aggregate_score for r in search.anchor_scores(df, anchors).collect()}
    assert got == {1: 0.0, 2: 1.0}
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "d")], "article_id int, idx int, text string")
    got = {r.idx: (r.context_before, r.context_after) for r in search.adjacent(rows).collect()}
    assert got == {0: (None, "b"), 1: ("a", None), 3: (None, None)}


def long_rows(spark, y, pred, prob=None):
    items = [(i, a, b, prob[i] if prob else [float(x) for x in b]) for i, (a, b) in enumerate(zip(y, pred))]
    return E.long_form(spark.createDataFrame(items, "id int, y array<int>, pred array<int>, prob array<double>"), "y", "pred", "prob")


def test_multilabel_values(spark):
    eye = np.eye(5, dtype=int).tolist()
    perfect = E.global_metrics(long_rows(spark, eye, eye)).first()
    assert perfect.macro_f1 == perfect.micro_f1 == perfect.subset_accuracy == 1 and perfect.hamming_loss == 0
    miss = [r[:] for r in eye]
    miss[0][0] = 0
    assert E.global_metrics(long_rows(spark, eye, miss)).first().macro_f1 == 0.8
    y = [[1, 1, 0, 0, 0], [1, 1, 1, 1, 0], [0, 0, 1, 1, 0]]
    got = E.global_metrics(long_rows(spark, y, y)).first()
    assert got.cardinality == round(8 / 3, 4) and got.density == round(8 / 15, 4)
    m = {r["class"]: r for r in E.class_metrics(long_rows(spark, [[1, 0, 1, 0, 0], [1, 0, 1, 0, 0]], [[1, 0, 1, 1, 0], [0, 0, 1, 0, 0]])).collect()}
    assert (m["definition"].precision, m["definition"].recall, m["definition"].f1) == (1, 0.5, 0.6667)
    assert (m["determinant"].precision, m["determinant"].recall, m["determinant"].f1, m["determinant"].specificity) == (None, None, None, 1)
    assert m["type_dimension"].specificity is None and not m["type_dimension"].is_valid
    zero = E.class_zero_metrics(long_rows(spark, [[1, 0, 0, 0, 0]] * 2, [[0] * 5, [1, 0, 0, 0, 0]])).first()
    assert zero.fp == 1 and zero.specificity == 1 and zero.fpr == 0 and zero.recall is None
    checks = {(r.check, r["class"]) for r in E.consistency_checks(long_rows(spark, eye, eye)).collect()}
    assert ("few_items", "all") in checks and ("all_perfect", "all") in checks and ("low_support", "property") in checks


def test_curves_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, (60, 5))
    p = np.round(rng.random((60, 5)), 1)
    rows = long_rows(spark, y.tolist(), (p >= 0.5).astype(int).tolist(), p.tolist())
    auc = {r["class"]: r.roc_auc for r in E.roc_auc(rows).collect()}
    ap = {r["class"]: r.average_precision for r in E.average_precision(rows).collect()}
    for k, c in enumerate(L.CLASSES):
        a, b = p[y[:, k] == 1, k], p[y[:, k] == 0, k]
        assert auc[c] == pytest.approx(((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()), abs=1e-4)
        want, last = 0.0, 0.0
        for t in sorted(set(p[:, k]), reverse=True):
            on = p[:, k] >= t
            rec = (y[on, k]).sum() / y[:, k].sum()
            want += (rec - last) * y[on, k].mean()
            last = rec
        assert ap[c] == pytest.approx(want, abs=1e-4)


def test_calibration_and_ranking(spark):
    gold = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 0)], "paragraph_id string, human_label int")
    res = spark.createDataFrame([("a", 0.9, 1), ("c", 0.76, 2), ("b", 0.6, 3), ("d", 0.3, 4)], "paragraph_id string, aggregate_score double, rank int")
    best = E.calibrate(res, gold).first()
    assert best.recall >= 0.9 and best.threshold <= 0.76 and best.f1 == 1 and best.threshold == 0.62
    m = E.ranking_metrics(res, gold).first()
    assert (m.precision_at_k, m.recall_at_k, m.mrr, m.map, m.ndcg) == (0.5, 1, 1, 1, 1)
    none = E.calibrate(res, gold.limit(0)).first()
    assert none.threshold == 0.5 and not none.calibrated


def test_kappa(spark):
    rows = [(i, who, i * 2 + who, [1] if (i < 2) == (who == 0 or i != 4) else [0]) for i in range(5) for who in (0, 1)]
    rows = [(i, 0, 2 * i, [1] if v else [2]) for i, v in enumerate([1, 1, 0, 0, 1])] + [(i, 1, 2 * i + 1, [1] if v else [2]) for i, v in enumerate([1, 1, 0, 0, 0])]
    got = {r["class"]: r for r in A.agreement(spark.createDataFrame(rows, "paragraph_id int, annotator_id int, seq int, classes array<int>")).collect()}
    assert got[1].p_o == 0.8 and got[1].kappa == pytest.approx((0.8 - 0.48) / 0.52, abs=1e-4) and got[3].kappa == 1


def chunk_rule(text, limit):
    import re

    out, cur, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if n + len(s) > limit and cur:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += len(s)
    return out + ([" ".join(cur)] if cur else [])


def test_chunks_and_segments(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text not like '%\n%'")
    for r in docs.select("text", S.chunks(F.col("text")).alias("c")).collect():
        assert r.c == chunk_rule(r.text, 500)
    text = "Ab cd. Ef gh. Ij kl."
    assert one(spark, S.overlapping_chunks(F.col("t"), 12, 6), t=("string", text)) == ["Ab cd. Ef gh.", "Ef gh. Ij kl."]
    long = "x" * 501
    assert one(spark, S.chunks(F.col("t")), t=("string", long)) == [long]
    md = "---\ntitle: X\n---\n<!-- page: 1 -->\n# Introdução\n\nEste é um parágrafo com palavras bastantes para ser válido aqui.\n\n<!-- page: 2 -->\n## Métodos\n\nOutro parágrafo longo com palavras bastantes para ser válido também.\ncurto demais? não.\n\nok"
    got = S.markdown_segments(spark.createDataFrame([("A", md)], "article_id string, text string")).orderBy("segment_index_in_doc").collect()
    assert [(g.paragraph_id, g.page_start, g.section, g.status) for g in got] == [("P0001", 1, "Introdução", "valid_paragraph"), ("P0002", 2, "Métodos", "valid_paragraph"), ("P0003", 2, "Métodos", "excluded_short_fragment")]
    assert len(got[0].text_sha256) == 64
    plain = S.plain_segments(spark.createDataFrame([("D", "# T\n\none two three four five\n\nshort one\n\n" + ("word " * 30 + ". ") * 8)], "article_id string, text string")).orderBy("paragraph_index").collect()
    assert plain[0].paragraph_id == "D_P000001" and plain[1].paragraph_id == "D_P000002_S01" and len(plain) > 2
    parts = S.front_matter(F.col("t"))
    assert one(spark, S.yaml_value(parts["yaml"], "title"), t=("string", md)) == "X"


def test_text_functions(spark):
    s = lambda c, t: one(spark, c, t=("string", t))
    assert s(T.tokens("t"), "The útil ação of x9abc über_x and dados") == ["útil", "ação", "dados"]
    assert s(T.normalize_text("t"), "café\x07  a \t b \n  c  ") == "café a b\nc"
    assert s(T.recompose_hyphens("t"), "exem-\n  plo e sub-Item") == "exemplo e sub-Item"
    assert s(T.first_doi("t"), "see 10.1234/abc.5;, x") == "10.1234/abc.5" and s(T.first_doi("t"), "none") is None
    assert s(T.first_year("t"), "text 1984 only\nPublished online 12 May 2019") == 2019 and s(T.first_year("t"), "x 1875") is None
    assert s(T.authors("t"), "Ana Souza, Bo Li; Carl Orff and Di") == ["Ana Souza", "Bo Li", "Carl Orff"]
    assert s(T.title("t"), "ISSN 1234-5678 x\nA study of things\nthat are rather long\nmore") == "A study of things that are rather long"
    assert s(T.language("t"), "the cat of the house and the dog in the yard") == "en" and s(T.language("t"), "x") == T.UNKNOWN
    assert s(T.journal("t"), "x\nJournal of Things\n") == "Journal of Things"
    assert s(T.safe_filename("t"), "Título: é/a - b") == "Titulo_ea_b" and s(T.safe_filename("t"), "///") == "documento"
    assert s(T.word_count("t"), " a b \n c ") == 3
    assert one(spark, T.duration_text("t"), t=("double", 3725.0)) == "1h 02m 05s" and one(spark, T.size_text("t"), t=("long", 2048)) == "2.0 KB"
    assert one(spark, T.page_range("a", "b"), a=("int", 3), b=("int", 4)) == "3-4"
    full = one(spark, T.reference_evidence(F.col("a"), F.lit(0.8)), a=("array<string>", ["[1] a (1990)", "[2] b (1991)", "[3] c (1992) (1993) (1994)"]))
    assert full == pytest.approx(1.0) and one(spark, T.reference_evidence(F.col("a"), F.lit(0.2)), a=("array<string>", [])) == pytest.approx(0.3)
    assert s(T.is_reference_title("t"), "## 7. Referências Bibliográficas") and not s(T.is_reference_title("t"), "The references in prose")


def test_reference_removal(spark):
    refs = "References\n" + "\n".join(f"[{i}] Author ({1990 + i}) Title. doi:10.1234/x{i}" for i in range(1, 8))
    rows = [("high", 1, "Intro\ntext"), ("high", 2, "Body\nmore"), ("high", 3, "End of body\n" + refs), ("high", 4, "[9] X (2001)"),
            ("low", 1, "We cite references here"), ("low", 2, "in the references of prose"), ("early", 1, refs), ("early", 2, "b"), ("early", 3, "c"), ("top", 1, "a"), ("top", 2, refs)]
    pages = spark.createDataFrame(rows, "article_id string, page int, text string")
    d = {r.article_id: r for r in references.decisions(pages).collect()}
    assert d["high"].references_removed and d["high"].start_page == 3 and d["high"].confidence >= 0.6 and d["high"].detected_title == "References"
    assert not d["low"].references_removed and d["low"].confidence == 0 and not d["early"].references_removed
    kept = {(r.article_id, r.page): r.text for r in references.remove_references(pages).collect()}
    assert kept["high", 3] == "End of body" and ("high", 4) not in kept and ("top", 2) not in kept and kept["low", 2] == "in the references of prose" and ("early", 3) in kept
    assert references.remove_references(pages.limit(0)).count() == 0


def test_ingest_and_project(spark, tmp_path):
    pages = [(1, "A study of large things in small places\n\nThe text of the page with the words of the kind that a para-\ngraph needs."), (2, "More of the text and more of the words in the page, enough for the limit.\nReferences\n[1] A 1990\n[2] B 1991\n[3] C 1992 1993 1994")]
    arts = spark.createDataFrame([("h1.pdf", bytearray(b"x"), [{"page": p, "text": t} for p, t in pages], None, "Ana Souza; Bo Li", "D:20190512")], "source_pdf string, content binary, pages array<struct<page:int,text:string>>, title string, author string, creation_date string")
    meta = ingest.metadata(arts).first()
    assert meta.article_id.startswith("SLD-") and meta.authors == ["Ana Souza", "Bo Li"] and meta.year == 2019 and meta.language == "en" and meta.title == "A study of large things in small places" and "doi" in meta.metadata_warnings[0]
    out = ingest.process(arts).collect()
    assert [o.status for o in out] == ["success"] and "paragraph needs" in out[0].markdown and "[1] A" not in out[0].markdown and "<!-- page: 2 -->" in out[0].markdown
    project = Project(spark, str(tmp_path / "p"))
    assert not project.exists()
    project.create({"min_words": 8})
    project.write_stage("segments", ingest.segments(ingest.process(arts)))
    project.set_status("segmented")
    again = Project(spark, str(tmp_path / "p"))
    assert again.metadata()["status"] == "segmented" and again.read_stage("segments").count() == 3 and again.read_stage("index") is None
    assert dict(again.stages())["segments"] and not dict(again.stages())["index"]


def test_headers_and_cooccurrence(spark):
    pages = spark.createDataFrame([("A", i, f"Journal header\nbody {i} text\n{i}") for i in range(5)], "article_id string, page int, text string")
    assert [(r.line, r.n) for r in explore.repeated_lines(pages).collect()] == [("Journal header", 5)]
    assert all("header" not in r.text for r in explore.drop_repeated_lines(pages).collect())
    p = spark.createDataFrame([(1, "gato cão peixe"), (2, "gato cão"), (3, "gato")], "article_id int, text string")
    assert [(r.a, r.b, r.weight) for r in explore.cooccurrence(p).collect()] == [("cão", "gato", 2)]
    m = {r.term: r for r in explore.cooccurrence_matrix(p).collect()}
    assert m["gato"]["cão"] == 2 and m["cão"]["gato"] == 2 and m["gato"]["gato"] == 0
    assert explore.descriptors(p.limit(0)).first().n_documents == 0


def test_forms(spark):
    body = "---\nsld_annotation_format: 1\n---\n\n# x\n## Trecho 1\n\ndocument_id: D  \nparagraph_id: P1  \ntext_hash: h  \n\n### Texto\n\nabc def\n\n### Classificação\n\n- [x] 1 — a\n- [V] 2 — b\n\n### Observação opcional\n\nnote here\n\n---\n\n## Trecho 2\n\nparagraph_id: P2  \n\n- [x] 0 — n\n- [*] 3 — c\n\n## Trecho 3\n\nparagraph_id: P3\n\n- [ ] 0\n"
    got = {r.paragraph_id: r for r in A.parse_form(spark.createDataFrame([(body,)], "text string")).collect()}
    assert got["P1"].checked_classes == [1, 2] and got["P1"].status == "valid" and got["P1"].text == "abc def" and got["P1"].note == "note here"
    assert got["P2"].status == "invalid" and got["P2"].error and got["P3"].status == "unannotated"


def test_registry_and_integrity(spark):
    reg = spark.createDataFrame([("A1", "f1", "h1", 2), ("A2", "f2", "h2", 1)], "article_id string, source_filename string, pdf_sha256 string, version_number int")
    new = spark.createDataFrame([("x", "h1"), ("f2", "h9"), ("y", "h8")], "source_filename string, pdf_sha256 string")
    kinds = {r.source_filename: r.kind for r in corpus.classify_batch(new, reg).collect()}
    assert kinds == {"x": "duplicate", "f2": "modified", "y": "new"}
    v = {r.source_filename: (r.version_number, r.supersedes) for r in corpus.next_versions(corpus.classify_batch(new, reg), reg).collect()}
    assert v == {"x": (3, "A1"), "f2": (2, "A2"), "y": (1, None)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "segment_id int")
    status = lambda a, b: corpus.integrity(a, b).first().status
    assert status(ids(1, 2), ids(1, 2)) == "valid" and status(ids(1, 2), ids(1, 3)) == "warning" and status(ids(1, 1), ids(1, 2)) == "inconsistent" and status(ids(1).limit(0), ids(1)) == "critical"
    f = corpus.funnel(spark, [("a", ids(1, 2), ids(1)), ("b", ids(1).limit(0), ids(1).limit(0))]).orderBy("step").collect()
    assert [(r.removed, r.retention_pct) for r in f] == [(1, 50.0), (0, 100.0)]


def test_group_split(spark):
    df = spark.createDataFrame([(i, i % 20) for i in range(100)], "id int, article_id int")
    got = sampling.group_split(df, "article_id").groupBy("split").agg(F.count_distinct("article_id").alias("n"), F.collect_set("article_id").alias("a")).collect()
    by = {r.split: set(r.a) for r in got}
    assert {k: len(v) for k, v in by.items()} == {"train": 14, "val": 3, "test": 3} and sum(map(len, by.values())) == len(set.union(*by.values()))
    assert {r.split for r in sampling.group_split(df.filter("article_id < 2"), "article_id").collect()} == {"train"}


def test_classifier(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = np.stack([x[:, 0] > 0, x[:, 1] > 0.5, x[:, 2] > 0, np.ones(200), np.zeros(200)], 1).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "paragraph_id int, embedding array<double>, y array<int>")
    model = classify.OneVsRest().fit(df)
    out = model.transform(df).orderBy("paragraph_id").collect()
    # the optimum of the same weighted, penalised objective
    n, pos = 200, y[:, 0].sum()
    w = np.where(y[:, 0] == 1, n / (2 * pos), n / (2 * (n - pos)))
    z, b = np.zeros(4), 0.0
    for _ in range(30000):
        p = 1 / (1 + np.exp(-(x @ z + b)))
        g = w * (p - y[:, 0])
        z, b = z - 0.01 * (x.T @ g + z) / 10, b - 0.01 * g.sum() / 10
    want = 1 / (1 + np.exp(-(x @ z + b)))
    assert max(abs(r.probabilities["definition"] - v) for r, v in zip(out, want)) < 5e-3
    assert all(r.probabilities["causal_relation"] == 1 and r.probabilities["property"] == 0 for r in out)
    model.save(f"{tmp_path}/m")
    again = classify.OneVsRest.load(spark, f"{tmp_path}/m").transform(df).orderBy("paragraph_id").collect()
    assert [r.probabilities for r in again] == [r.probabilities for r in out]
    with pytest.raises(ValueError):
        classify.OneVsRest().fit(df.limit(0))
    with pytest.raises(RuntimeError):
        classify.OneVsRest().predict_proba(df)


def test_index(spark, tmp_path):
    rows = [("P1", "A", 1, ["definition"], "MODEL_RELEVANT"), ("P2", "A", 2, ["definition", "causal_relation", "property"], "MODEL_RELEVANT"), ("P3", "A", 3, [], "MODEL_NOT_RELEVANT"),
            ("P4", "B", 4, ["determinant", "type_dimension"], "MODEL_RELEVANT"), ("P2", "A", 5, ["definition"], "MODEL_RELEVANT"), ("P6", "B", 6, ["definition"], "MODEL_NOT_RELEVANT")]
    c = spark.createDataFrame(rows, "paragraph_id string, article_id string, seq int, predicted_labels array<string>, status string")
    v = spark.createDataFrame([(f"P{i}", np.eye(6)[i - 1].tolist()) for i in range(1, 7)], "paragraph_id string, embedding array<double>")
    idx = index.build(c, v)
    got = sorted((r.faiss_id, r.paragraph_id, r.class_1, r.class_2, r.class_4, r.class_5) for r in idx.collect())
    assert [g[:2] for g in got] == [(0, "P1"), (1, "P2"), (2, "P4")] and got[1][2:] == (True, False, True, True)
    index.save(idx, f"{tmp_path}/i", {"model": "m"})
    again, manifest = index.load(spark, f"{tmp_path}/i")
    assert manifest["n_vectors"] == 3 and again.exceptAll(idx).count() == 0
    hits = index.query(again, np.eye(6)[1].tolist(), 10, ["1"], 0.5, 1.0).collect()
    assert [(h.paragraph_id, h.score) for h in hits] == [("P2", 1.0)]
    more = index.class_flags(c.filter("paragraph_id in ('P3', 'P6')")).join(v, "paragraph_id")
    assert index.append(spark, f"{tmp_path}/i", more, {"model": "m"})["n_vectors"] == 5
    with pytest.raises(ValueError):
        index.append(spark, f"{tmp_path}/i", more, {"model": "other"})


def test_extraction(spark):
    raw = ['{"main_concept": "x", "factors": ["a", "b"], "relations": ["r"], "evidence": ["Foo  BAR", " "]}', '{"concepts": [], "main_concept": "x", "evidence": ["missing"]}', "{broken", "[1]", None]
    df = spark.createDataFrame([(i, "some foo bar text", r) for i, r in enumerate(raw)], "id int, text string, raw string")
    got = {r.id: r for r in extract.parse(df).withColumn("ok", extract.evidence_valid(F.col("text"), F.col("evidence"))).collect()}
    assert got[0].concepts == ["x"] and got[0].determinants == ["a", "b"] and got[0].causal_relations == ["r"] and got[0].ok and got[0].confidence == 1
    assert got[1].concepts == [] and not got[1].ok and [got[i].json_valid for i in range(5)] == [True, True, False, False, False]
    assert extract.min_interval(10) == 6 and extract.remaining_seconds(10, 10) == 60 and extract.min_interval(None) == 0
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "boom")], "id int, text string")

    def provider(text):
        if text == "boom":
            raise RuntimeError
        return extract.mock_provider(text)

    keyed = extract.keyed(docs, "mock", "v1", "{}")
    out = extract.extract(keyed, provider).cache()
    r = {x.id: x for x in out.collect()}
    assert r[1].evidence == ["one two three four five"] and r[1].evidence_valid and not r[2].json_valid
    assert [x.id for x in extract.misses(keyed, out).collect()] == [2]
    assert extract.refined(out).count() == 1


def test_sources_sinks_and_streams(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in ("a.pdf", "dir/b.PDF", "__MACOSX/c.pdf", ".hidden.pdf", "t.txt", "../evil.pdf"):
            z.writestr(name, b"x")
    files = spark.createDataFrame([("z.zip", bytearray(buf.getvalue()), ), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    m = readers.archive_members(files).collect()
    assert {x.member for x in m if x.content} == {"a.pdf", "dir/b.PDF"} and {x.error for x in m if x.error} == {"unsafe path", "not an archive"}
    with pytest.raises(readers.UnsafeArchive):
        readers.require_safe(readers.archive_members(files))
    pages = readers.read_pages(files, lambda b: ["one", "two"]).first().pages
    assert [p.text for p in pages] == ["one", "two"] and pages[1].page == 2
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "md").mkdir()
    (tmp_path / "md/one.md").write_text("# T")
    (tmp_path / "md/README.md").write_text("no")
    assert [r.article_id for r in readers.markdown_files(spark, str(tmp_path / "md")).collect()] == ["one"]
    emb = readers.encode_texts(spark.createDataFrame([("a b",), ("",), (None,)], "text string")).collect()
    assert sum(x * x for x in emb[0].embedding) == pytest.approx(1, abs=1e-5) and not any(emb[1].embedding)
    df = spark.createDataFrame([("P1", "txt", {"definition": 0.91234}, ["definition"]), ("P2", "t", {"definition": 0.1}, [])], "paragraph_id string, text string, probabilities map<string,double>, predicted_labels array<string>")
    flat = {r.paragraph_id: r for r in writers.flatten_probabilities(df).collect()}
    assert flat["P1"].max_probability == 0.9123 and flat["P2"].labels == "Nenhum"
    for kind in writers.FORMATS:
        writers.export(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    src = str(tmp_path / "in")
    for batch in (1, 2):
        spark.createDataFrame([(1, batch), (batch + 1, batch)], "id int, v int").coalesce(1).write.mode("append").parquet(src)
        n = incremental.process_new_files(spark, src, "id int, v int", lambda d: d.filter("v > 0"), str(tmp_path / "out"), str(tmp_path / "cp"))
        incremental.upsert_stream(spark, src, "id int, v int", ["id"], str(tmp_path / "up"), str(tmp_path / "cp2"))
        assert n == 2 * batch
    assert sorted(map(tuple, incremental.current(spark, str(tmp_path / "up")).collect())) == [(1, 2), (2, 1), (3, 2)]
    text = report.methodology("r1", {"Corpus": {"n": 2}}, {"Funnel": corpus.funnel(spark, [("a", df, df)])})
    assert "## 16. Funnel" in text and "| step |" in text and "Not run." in text


def test_lines_of_long_documents_stay_apart(spark, tmp_path):
    from litspark.plans import text_plans

    rows = [(1, "\n" * 100_000 + "alpha\n" * 5), (2, "beta\n" * 5), (3, "gamma delta\n" * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in text_plans.cooccurrence_line(spark, str(tmp_path)).collect()]
    assert got == [("delta", "gamma", 5)]


def test_segment_ids_stay_unique(spark):
    """More than 99 chunks and 9,999 paragraphs have more digits, not fewer."""
    long = " ".join(f"Sentence number {i} of a very long paragraph ends here." for i in range(1_500))
    many = "\n\n".join(f"Paragraph {i} has eight words or more in it." for i in range(10_500))
    df = spark.createDataFrame([("A", long), ("B", many)], "article_id string, text string")
    from litspark.functions import segment

    plain = segment.plain_segments(df)
    assert plain.count() == plain.select("paragraph_id").distinct().count() > 10_600
    assert plain.filter("paragraph_id = 'A_P000001_S100'").count() == 1
    md = segment.markdown_segments(df)
    assert md.count() == md.select("segment_id").distinct().count() and md.filter("segment_id in ('A_P0001_C100', 'B_P10500')").count() == 2
    for sf in ("sf0.1",):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").selectExpr("doc_id article_id", "text")
        ids = segment.markdown_segments(docs).agg(F.count("*").alias("n"), F.count_distinct("segment_id").alias("d")).first()
        assert ids.n == ids.d


def test_index_integrity(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        index.load(spark, f"{tmp_path}/none")
    rows = spark.createDataFrame([(0, "P1", [1.0, 0.0]), (1, "P2", [0.0, 1.0])], "faiss_id long, paragraph_id string, embedding array<double>")
    index.save(rows, f"{tmp_path}/i", {"model": "m"})
    index.append(spark, f"{tmp_path}/i", spark.createDataFrame([("P3", [1.0, 1.0])], "paragraph_id string, embedding array<double>"), {"model": "m"})
    have, manifest = index.load(spark, f"{tmp_path}/i")
    assert manifest["n_vectors"] == 3 == have.count() and manifest["version"] == 2 and manifest["config"]["version"] == 2
    rows.limit(1).write.parquet(f"{tmp_path}/i/data-000003")  # an append that died before its manifest
    assert index.load(spark, f"{tmp_path}/i")[1]["version"] == 2
    rows.withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5))).write.mode("overwrite").parquet(f"{tmp_path}/i/data-000002")
    with pytest.raises(ValueError):
        index.load(spark, f"{tmp_path}/i")
    import shutil

    shutil.rmtree(f"{tmp_path}/i/data-000001")
    with pytest.raises(FileNotFoundError):
        index.load(spark, f"{tmp_path}/i")


def test_extraction_keeps_cached_rows_and_resumes(spark, tmp_path):
    docs = extract.keyed(spark.createDataFrame([(1, "one two"), (2, "boom"), (3, "one two")], "id int, text string"), "mock", "v1", "{}")

    def broken(text):
        if text == "boom":
            raise RuntimeError
        return extract.mock_provider(text)

    first = extract.extract_to(docs, f"{tmp_path}/a", broken, steps=3)
    assert sorted((r.id, r.json_valid) for r in first.collect()) == [(1, True), (2, False), (3, True)]
    asked = spark.read.parquet(f"{tmp_path}/a/answers")
    assert asked.count() == 2  # equal texts are asked once
    again = extract.extract_to(docs, f"{tmp_path}/a", extract.mock_provider, steps=3)
    assert sorted((r.id, r.json_valid) for r in again.collect()) == [(1, True), (2, True), (3, True)]
    assert spark.read.parquet(f"{tmp_path}/a/answers").count() == 3
    out = extract.extract(docs, extract.mock_provider, rpm=6000, cache=asked, workers=2)
    assert sorted((r.id, r.evidence_valid) for r in out.collect()) == [(1, True), (2, True), (3, True)]


def test_scores_fall_back_to_the_paragraph(spark):
    corpus = spark.createDataFrame([("A", "P1"), ("B", "P1"), ("C", "P9")], "article_id string, paragraph_id string")
    results = spark.createDataFrame([("A", "P1", 0.4, 1), ("X", "P1", 0.3, 2)], "article_id string, paragraph_id string, aggregate_score double, rank int")
    got = sorted(map(tuple, search.attach_scores(corpus, results).collect()))
    assert got == [("A", "P1", 0.4), ("B", "P1", 0.3), ("C", "P9", 0.0)]


def test_report_tables_are_whole(spark):
    from litspark.sources.writers import markdown_table

    with pytest.raises(ValueError):
        markdown_table(spark.range(6), limit=5)
