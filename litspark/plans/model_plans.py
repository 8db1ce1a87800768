"""Classifier, index and structured-extraction queries."""

from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from ..operators import classify, extract, index, ivf
from .registry import query, table
from .search_plans import BASE, scored

# Probabilities of the five classes are the rescaled similarities to the five anchors.
NAMES = "['" + "', '".join(CLASSES) + "']"
CLASSIFIED = BASE + f"""
pr AS (SELECT article_id, paragraph_id, {NAMES}[pos] AS class, round((1 + s) / 2, 6) AS p FROM s),
pl AS (SELECT article_id, paragraph_id, list(class ORDER BY list_position({NAMES}, class)) FILTER (p >= 0.6) AS l, max(p) AS p_max FROM pr GROUP BY 1, 2),
c AS (SELECT article_id, paragraph_id, coalesce(l, []) AS l, p_max, CASE WHEN l IS NULL THEN 'MODEL_NOT_RELEVANT' ELSE 'MODEL_RELEVANT' END AS status FROM pl),
"""


def classified(spark, sf_dir):
    s = scored(spark, sf_dir, ranked=False)
    p = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.transform(F.map_values("anchor_scores"), lambda v: F.round((1 + v) / 2, 6)))
    return classify.apply_thresholds(s.withColumn("probabilities", p), dict.fromkeys(CLASSES, 0.6))


@query(CLASSIFIED.rstrip().rstrip(",") + "SELECT article_id, paragraph_id, array_to_string(l, ',') AS labels, status FROM c")
def classified_corpus(spark, sf_dir):
    return classified(spark, sf_dir).select("article_id", "paragraph_id", F.array_join("predicted_labels", ",").alias("labels"), "status")


@query(CLASSIFIED.rstrip().rstrip(",") + """
SELECT class, count(*) FILTER (list_contains(l, class)) AS n_paragraphs, count(DISTINCT article_id) FILTER (list_contains(l, class)) AS n_documents,
  round(100.0::DOUBLE * count(*) FILTER (list_contains(l, class)) / count(*), 2) AS pct, round(avg(p), 4) AS mean_p, round(median(p), 4) AS median_p, round(max(p), 4) AS max_p
FROM pr JOIN c USING (article_id, paragraph_id) GROUP BY 1""")
def classified_class_stats(spark, sf_dir):
    return classify.class_statistics(classified(spark, sf_dir))


@query(CLASSIFIED + "u AS (SELECT paragraph_id, unnest(l) AS t FROM c) SELECT x.t AS a, y.t AS b, count(*) AS n FROM u x JOIN u y ON x.paragraph_id = y.paragraph_id AND x.t <= y.t GROUP BY 1, 2")
def class_cooccurrence(spark, sf_dir):
    return classify.class_cooccurrence(classified(spark, sf_dir))


@query(CLASSIFIED.rstrip().rstrip(",") + "SELECT article_id, round(max(p_max), 4) AS p_max, count(*) AS n FROM c GROUP BY 1")
def pmax_doc(spark, sf_dir):
    return classify.p_max(classified(spark, sf_dir))


@query(CLASSIFIED + """d AS (SELECT article_id, count(*) FILTER (status = 'MODEL_RELEVANT') AS n FROM c GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS relevant_docs, count(*) FILTER (n = 0) AS not_relevant_docs, round(avg(n) FILTER (n > 0), 4) AS mean_paragraphs, round(median(n) FILTER (n > 0), 4) AS median_paragraphs FROM d""")
def coverage_docs(spark, sf_dir):
    return classify.document_coverage(classified(spark, sf_dir))


@query(CLASSIFIED.rstrip().rstrip(",") + "SELECT article_id FROM c GROUP BY 1 HAVING count(*) FILTER (status = 'MODEL_RELEVANT') = 0")
def documents_without_evidence(spark, sf_dir):
    return classify.documents_without(classified(spark, sf_dir))


@query(CLASSIFIED.rstrip().rstrip(",") + "SELECT e.vec_id AS paragraph_id, coalesce(c.status, 'RAW') AS status, coalesce(len(l), 0)::INT AS n_labels FROM embeddings e LEFT JOIN c ON e.vec_id = c.paragraph_id")
def classified_sync(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paragraph_id"), F.lit("OLD").alias("status"))
    return classify.sync(corpus, classified(spark, sf_dir)).select("paragraph_id", "status", F.size("predicted_labels").alias("n_labels"))


INDEX = CLASSIFIED + "r AS (SELECT article_id, paragraph_id, paragraph_id AS seq, l, status FROM c UNION ALL SELECT article_id, paragraph_id, paragraph_id + 1000000000000 AS seq, l, status FROM c), f AS (SELECT * FROM r WHERE status <> 'MODEL_NOT_RELEVANT' AND len(l) > 0),\nx AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY seq) = 1),"


def _repeating(spark, sf_dir):
    """The corpus twice, as two batches of the same paragraph ids in ingest order seq."""
    c = classified(spark, sf_dir).select("article_id", "paragraph_id", F.col("paragraph_id").alias("seq"), "predicted_labels", "status")
    return c.unionByName(c.withColumn("seq", F.col("seq") + 1_000_000_000_000))


def _index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paragraph_id"), "embedding")
    return index.build(_repeating(spark, sf_dir), vectors)


@query(INDEX.rstrip(",") + """ SELECT row_number() OVER (ORDER BY seq, paragraph_id) - 1 AS faiss_id, article_id, paragraph_id, list_contains(l, 'definition') AS class_1, list_contains(l, 'determinant') AS class_2,
  list_contains(l, 'type_dimension') AS class_3, list_contains(l, 'causal_relation') AS class_4, list_contains(l, 'property') AS class_5 FROM x""")
def rag_dedup(spark, sf_dir):
    return _index(spark, sf_dir).select("faiss_id", "article_id", "paragraph_id", *(f"class_{i}" for i in range(1, 6)))


@query(INDEX + "t AS (SELECT count(DISTINCT paragraph_id) AS n_relevant, CAST(sum(len(l)) AS BIGINT) AS n_occurrences FROM f), u AS (SELECT unnest(l) AS class FROM f) SELECT class, count(*) AS n, max(n_relevant) AS n_relevant, max(n_occurrences) AS n_occurrences, round(100.0::DOUBLE * count(*) / max(n_occurrences), 2) AS pct FROM u, t GROUP BY 1")
def rag_distribution(spark, sf_dir):
    return index.distribution(_repeating(spark, sf_dir))


@query(INDEX + "d AS (SELECT article_id, count(*) AS n FROM x GROUP BY 1) SELECT count(*) AS articles_with, round(avg(n), 4) AS mean, round(median(n)::DOUBLE, 4) AS median, round(min(n)::DOUBLE, 4) AS min, round(max(n)::DOUBLE, 4) AS max, (SELECT count(DISTINCT article_id) FROM p) AS articles, round(100.0::DOUBLE * count(*) / (SELECT count(DISTINCT article_id) FROM p), 2) AS coverage_pct FROM d")
def rag_coverage(spark, sf_dir):
    c = _repeating(spark, sf_dir)
    return index.coverage(c.select("article_id"), index.filter_and_deduplicate(c, "seq"))


@query(INDEX + """n AS (SELECT *, row_number() OVER (ORDER BY seq, paragraph_id) - 1 AS faiss_id FROM x),
h AS (SELECT n.faiss_id, n.paragraph_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM n JOIN embeddings e ON e.vec_id = n.paragraph_id, embeddings q
  WHERE q.vec_id = 57 AND list_contains(l, 'determinant')),
k AS (SELECT * FROM h WHERE score >= 0.05 AND score <= 0.99 ORDER BY score DESC, faiss_id LIMIT 10) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, faiss_id) AS INT) AS rank FROM k""")
def rag_query_filtered(spark, sf_dir):
    vector = [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 57").first().embedding]
    out = index.query(_index(spark, sf_dir), vector, 10, ["2", "class_9"], 0.05, 0.99)
    return out.select("faiss_id", "paragraph_id", "score", "rank")


def _inverted(spark, sf_dir, metric):
    from ..sources.shared import new_path

    path = new_path(spark, "inverted")
    ivf.build(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("faiss_id"), "embedding"), path, metric=metric)
    return ivf.InvertedFile(spark, path, check=True)


def _asked(spark, sf_dir, rest, of):
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % of == rest).select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def ivf_search(spark, sf_dir):
    """The approximate index over all vectors; probes are tuned on other queries; tests hold its recall against brute force."""
    found = _inverted(spark, sf_dir, "cosine")
    probes, _ = found.tune(_asked(spark, sf_dir, 25, 50), 10, 0.97)
    return found.search(_asked(spark, sf_dir, 0, 50), 10, probes).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("""SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def ivf_exact_l2(spark, sf_dir):
    """Exact Euclidean search: after a few cells only those that can hold a better vector."""
    return _inverted(spark, sf_dir, "l2").search(_asked(spark, sf_dir, 0, 50), 10, 4, exact=True).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query(INDEX + """n AS (SELECT *, row_number() OVER (ORDER BY seq, paragraph_id) - 1 AS faiss_id FROM x),
h AS (SELECT n.faiss_id, q.vec_id AS query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM n JOIN embeddings e ON e.vec_id = n.paragraph_id, embeddings q
  WHERE q.vec_id % 100 = 57 AND list_contains(l, 'determinant')),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, faiss_id) AS INT) AS rank FROM h WHERE score >= 0.05 AND score <= 0.99) SELECT query_id, rank, faiss_id, score FROM k WHERE rank <= 10""")
def ivf_filtered(spark, sf_dir):
    """Filters on the index of refined paragraphs: classes and a range of scores, for several queries at once."""
    from ..sources.shared import new_path

    path = new_path(spark, "inverted")
    ivf.build(_index(spark, sf_dir), path, config={"model": "given"})
    found = ivf.InvertedFile(spark, path).search(_asked(spark, sf_dir, 57, 100), 10, 2, exact=True, classes=["2"], min_score=0.05, max_score=0.99)
    return found.select("query_id", "rank", F.col("id").alias("faiss_id"), "score")


@query()
def logistic_ovr_predict(spark, sf_dir):
    """Trained one-vs-rest models; checked in tests against the optimum of the same objective."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.transform(F.array(*map(F.lit, range(5))), lambda c: (F.col("label") % 5 == c).cast("int")).alias("y"))
    model = classify.OneVsRest().fit(e.filter("vec_id % 5 > 0"))
    out = model.transform(e)
    return out.select("vec_id", F.array_join("predicted_labels", ",").alias("labels"), "status", *(F.col("probabilities")[c].alias(c) for c in CLASSES))


JSON = """to_json(named_struct('main_concept', case when doc_id % 2 = 0 then source end, 'factors', array(lang, source), 'definitions', array(substr(text, 1, 20)),
  'evidence', array(substr(text, 5, 30), case when doc_id % 3 = 0 then 'not in the text 12345' else lower(substr(text, 1, 25)) end), 'confidence', 0.5))"""


def answers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 == 9, "{broken").otherwise(F.expr(JSON)).alias("raw"))


ANSWERS = r"""
WITH d AS (SELECT doc_id, source, lang, text, doc_id % 10 <> 9 AS ok, text[1:20] AS def, [text[5:34], CASE WHEN doc_id % 3 = 0 THEN 'not in the text 12345' ELSE lower(text[1:25]) END] AS ev FROM documents),
k AS (SELECT *, CASE WHEN ok THEN list_filter(ev, lambda e: trim(e) <> '') ELSE [] END AS sn FROM d),
v AS (SELECT *, list_filter(sn, lambda e: contains(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')), trim(regexp_replace(lower(e), '[\s\p{Z}]+', ' ', 'g')))) AS good FROM k)
"""


@query(ANSWERS + """SELECT doc_id, ok AS json_valid, CASE WHEN ok AND doc_id % 2 = 0 THEN source ELSE '' END AS concepts, CASE WHEN ok THEN lang || ',' || source ELSE '' END AS determinants,
  CASE WHEN ok THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM v""")
def json_alias_extract(spark, sf_dir):
    p = extract.parse(answers(spark, sf_dir))
    return p.select("doc_id", "json_valid", F.array_join("concepts", ",").alias("concepts"), F.array_join("determinants", ",").alias("determinants"), "confidence")


@query(ANSWERS + "SELECT doc_id, CAST(len(sn) AS INT) AS n_snippets, CAST(len(good) AS INT) AS n_valid, len(sn) = len(good) AS evidence_valid FROM v")
def evidence_validate(spark, sf_dir):
    p = extract.parse(answers(spark, sf_dir))
    e, t = F.col("evidence"), F.col("text")
    return p.select("doc_id", F.size(extract.snippets(e)).alias("n_snippets"), F.size(extract.valid_snippets(t, e)).alias("n_valid"), extract.evidence_valid(t, e).alias("evidence_valid"))


@query(ANSWERS + """SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 2) AS json_valid_pct, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 2) AS schema_valid_pct,
  round(100.0::DOUBLE * sum(len(good)) / sum(len(sn)), 2) AS evr, round(100.0::DOUBLE * count(*) FILTER (len(sn) > 0 AND len(sn) = len(good)) / count(*), 2) AS pvr FROM v""")
def evr_pvr(spark, sf_dir):
    return extract.statistics(extract.parse(answers(spark, sf_dir)))


@query(r"""SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[^\s\p{Z}]+'), 1, 5), ' ') AS evidence, true AS evidence_valid FROM documents""")
def mock_extraction(spark, sf_dir):
    p = extract.parse(extract.mock_answers(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return p.select("doc_id", F.array_join("evidence", "|").alias("evidence"), extract.evidence_valid(F.col("text"), F.col("evidence")).alias("evidence_valid"))


CACHED = "doc_id % 3 = 0"


@query(rf"""SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[^\s\p{{Z}}]+'), 1, CASE WHEN {CACHED} THEN 3 ELSE 5 END), ' ') AS evidence, {CACHED} AS cached, true AS evidence_valid FROM documents""")
def cached_extraction(spark, sf_dir):
    """Every document's answer: a third from the cache, whose provider quoted three words, the others asked for."""
    docs = extract.keyed(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "mock", "v1", "{}")
    docs = docs.withColumn("cache_key", F.concat("cache_key", F.lit("|"), F.col("doc_id").cast("string")))  # equal texts may be in both parts
    words = F.slice(F.filter(F.split("text", "(?U)\\s+"), lambda x: x != ""), 1, 3)
    old = docs.filter(CACHED).withColumn("raw", F.to_json(F.struct(F.array(F.array_join(words, " ")).alias("evidence"), F.lit(0.5).alias("confidence"))))
    out = extract.extract(docs, cache=extract.parse(old))
    return out.select("doc_id", F.array_join("evidence", "|").alias("evidence"), (F.col("confidence") == 0.5).alias("cached"), "evidence_valid")


@query("SELECT event_id, event_type, json_valid(props) AS valid, json_keys(props)[1] AS first_key FROM events")
def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.try_parse_json("props").isNotNull().alias("valid"), F.get(F.json_object_keys("props"), F.lit(0)).alias("first_key"))


