"""Label rules, annotation files, agreement and the gold standard.  Annotators are functions of the labels' rows."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import annotate as A
from .evaluation_plans import LONG, items
from .registry import query, table

RAW = "list_filter([CASE WHEN quality = 0 THEN 0 END, CASE WHEN toxic = 1 THEN 2 END, CASE WHEN doc_id % 3 = 0 THEN 5 END, CASE WHEN doc_id % 5 = 0 THEN 1 END, CASE WHEN doc_id % 3 = 0 THEN 5 END], lambda x: x IS NOT NULL)"
SANE = f"(CASE WHEN len(list_filter({RAW}, lambda x: x > 0)) > 0 THEN list_sort(list_distinct(list_filter({RAW}, lambda x: x > 0))) WHEN list_contains({RAW}, 0) THEN [0] ELSE [] END)"


def raw_labels(spark, sf_dir):
    parts = F.array(*(F.expr(f"case when {c} then {v} end") for c, v in (("quality = 0", 0), ("toxic = 1", 2), ("doc_id % 3 = 0", 5), ("doc_id % 5 = 0", 1), ("doc_id % 3 = 0", 5))))
    return table(spark, sf_dir, "labels").withColumn("labels", F.filter(parts, lambda x: x.isNotNull()))


@query(f"SELECT doc_id, array_to_string({SANE}, ',') AS labels FROM labels")
def label_sanitize(spark, sf_dir):
    return raw_labels(spark, sf_dir).select("doc_id", F.array_join(L.sanitize(F.col("labels")), ",").alias("labels"))


@query(f"SELECT doc_id, array_to_string(list_transform(range(1, 6), lambda c: CAST(list_contains({SANE}, c) AS INT)), '') AS vector, CASE WHEN len(list_filter({SANE}, lambda x: x > 0)) = 0 THEN '0' ELSE array_to_string({SANE}, ',') END AS back FROM labels")
def label_vector_roundtrip(spark, sf_dir):
    v = L.to_vector(F.col("labels"))
    return raw_labels(spark, sf_dir).select("doc_id", F.array_join(v, "").alias("vector"), F.array_join(L.from_vector(v), ",").alias("back"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 0 END, CASE WHEN doc_id % 5 = 0 THEN 1 END, CASE WHEN toxic = 1 THEN 2 END], lambda x: x IS NOT NULL), ',') AS classes,
  CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 5 <> 0 THEN 'unannotated' WHEN quality = 0 AND (toxic = 1 OR doc_id % 5 = 0) THEN 'invalid' ELSE 'valid' END AS status FROM labels
""")
def annotation_status(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality = 0 label_0", "doc_id % 5 = 0 label_1", "toxic = 1 label_2", "false label_3", "false label_4", "false label_5", "cast(null as array<int>) labels"
    )
    return A.validate_flags(rows).select("doc_id", F.array_join("classes", ",").alias("classes"), "status")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([quality, 2 + toxic, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 5 END], lambda x: x IS NOT NULL))), ',') AS classes FROM labels")
def csv_annotations(spark, sf_dir):
    text = F.concat(F.col("quality").cast("string"), F.lit("; "), (F.col("toxic") + 2).cast("string"), F.when(F.col("doc_id") % 4 == 0, ", five").otherwise(",5"))
    rows = table(spark, sf_dir, "labels").select("doc_id", text.alias("labels"))
    return A.validate_csv(rows).select("doc_id", F.array_join("classes", ",").alias("classes"))


ANN = LONG + """,
ann AS (SELECT id AS paragraph_id, who AS annotator_id, id * 2 + who AS seq, list_sort(list_filter(list(CASE WHEN CASE WHEN who = 0 THEN y ELSE pred END = 1 THEN k END), lambda x: x IS NOT NULL)) AS c0
  FROM (SELECT *, list_position(['definition', 'determinant', 'type_dimension', 'causal_relation', 'property'], class) AS k FROM long), (VALUES (0), (1)) v(who) WHERE who = 0 OR id % 4 > 0 GROUP BY 1, 2, 3),
a AS (SELECT paragraph_id, annotator_id, seq, CASE WHEN len(c0) = 0 THEN [0] ELSE c0 END AS classes FROM ann)
"""


def annotations(spark, sf_dir):
    it = items(spark, sf_dir)
    one = lambda v, who: it.select(F.col("id").alias("paragraph_id"), F.lit(who).alias("annotator_id"), (F.col("id") * 2 + who).alias("seq"), L.from_vector(F.col(v)).alias("classes"))
    return one("y", 0).unionByName(one("pred", 1).filter("paragraph_id % 4 > 0"))


@query(ANN + """, p AS (SELECT x.classes AS ca, y.classes AS cb FROM a x JOIN a y ON x.paragraph_id = y.paragraph_id AND x.annotator_id = 0 AND y.annotator_id = 1),
l AS (SELECT CAST(k AS INT) AS class, CAST(list_contains(ca, k) AS DOUBLE) AS a, CAST(list_contains(cb, k) AS DOUBLE) AS b FROM p, range(0, 6) r(k)),
s AS (SELECT class, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM l GROUP BY 1)
SELECT class, n, round(po, 4) AS p_o, round(pe, 4) AS p_e, round(CASE WHEN abs(1 - pe) < 1e-9 THEN CASE WHEN po > 1 - 1e-9 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM s""")
def cohen_kappa(spark, sf_dir):
    return A.agreement(annotations(spark, sf_dir))


@query(ANN + """, p AS (SELECT x.classes AS ca, y.classes AS cb FROM a x JOIN a y ON x.paragraph_id = y.paragraph_id AND x.annotator_id = 0 AND y.annotator_id = 1),
l AS (SELECT k, CAST(list_contains(ca, k) AS DOUBLE) AS a, CAST(list_contains(cb, k) AS DOUBLE) AS b FROM p, range(0, 6) r(k)),
s AS (SELECT k, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM l GROUP BY 1)
SELECT round(sum(CAST(round(10000 * round(CASE WHEN abs(1 - pe) < 1e-9 THEN CASE WHEN po > 1 - 1e-9 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 4)) AS BIGINT)) / count(*)) / 10000 AS macro_kappa, max(n) AS n_pairs FROM s""")
def macro_kappa(spark, sf_dir):
    return A.macro_kappa(annotations(spark, sf_dir))


@query(ANN + "SELECT paragraph_id, count(DISTINCT array_to_string(classes, ',')) AS n_sets, count(DISTINCT annotator_id) AS n_annotators FROM a GROUP BY 1 HAVING count(DISTINCT array_to_string(classes, ',')) > 1")
def annotation_conflicts(spark, sf_dir):
    return A.conflicts(annotations(spark, sf_dir))


@query(ANN + """SELECT (SELECT count(*) FROM documents) AS n_candidates, count(*) FILTER (seq % 11 > 0) AS n_valid, count(*) FILTER (seq % 11 > 0 AND seq % 2 = 0) AS n_gold,
  count(DISTINCT annotator_id) AS n_annotators, (SELECT count(*) FROM documents) - count(DISTINCT paragraph_id) AS n_unannotated FROM a""")
def annotation_overview(spark, sf_dir):
    a = annotations(spark, sf_dir).withColumn("status", F.when(F.col("seq") % 11 > 0, "valid").otherwise("invalid")).withColumn("included", F.col("seq") % 2 == 0)
    return A.overview(table(spark, sf_dir, "documents"), a)


@query(ANN + 'SELECT CAST(c AS INT) AS class, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM a), 2) AS pct FROM (SELECT unnest(classes) AS c FROM a) GROUP BY 1')
def label_frequency(spark, sf_dir):
    return A.label_frequency(annotations(spark, sf_dir))


@query("SELECT doc_id AS paragraph_id FROM labels WHERE doc_id % 9 > 0 AND doc_id % 2 = 0 AND quality = 1")
def gold_standard(spark, sf_dir):
    a = table(spark, sf_dir, "labels").selectExpr("doc_id paragraph_id", "if(doc_id % 9 > 0, 'valid', 'invalid') annotation_status", "doc_id % 2 = 0 included_in_gold_standard", "quality = 0 label_0")
    return A.gold_standard(a).select("paragraph_id")


@query("""
SELECT l.doc_id AS paragraph_id, 'a' || l.doc_id % 2 AS annotator_id, d.doc_id IS NULL AS unknown_paragraph, l.doc_id % 5 = 0 AND d.doc_id IS NOT NULL AS hash_differs, l.doc_id % 4 = 1 AS replaces
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 > 0) d USING (doc_id)
""")
def import_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    corpus = d.filter("doc_id % 7 > 0").select(F.col("doc_id").alias("paragraph_id"), T.text_hash("text").alias("text_sha256"))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("paragraph_id"), F.concat(F.lit("a"), (F.col("doc_id") % 2).cast("string")).alias("annotator_id"), F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(T.text_hash("text")).alias("text_hash")
    )
    have = rows.filter("paragraph_id % 4 = 1").select("paragraph_id", "annotator_id")
    return A.check_import(rows, corpus, have).drop("text_hash")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS paragraph_id, source AS document_id, sha256(text) AS text_hash, CASE WHEN doc_id % 3 = 0 THEN '1,4' WHEN doc_id % 3 = 1 THEN '' ELSE '0,2' END AS classes,
  CASE WHEN doc_id % 3 = 0 THEN 'valid' WHEN doc_id % 3 = 1 THEN 'unannotated' ELSE 'invalid' END AS status FROM documents
""")
def annotation_form_roundtrip(spark, sf_dir):
    """Forms written for all documents, filled in by rule and parsed again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paragraph_id"), F.col("source").alias("article_id"), "text")
    form = A.form_sections(d)
    fill = lambda t, *boxes: F.regexp_replace(t, "- \\[ \\] ([" + "".join(map(str, boxes)) + "]) —", "- [x] $1 —")
    s, n = F.col("section"), F.col("paragraph_id") % 3
    filled = form.select(F.when(n == 0, fill(s, 1, 4)).when(n == 2, fill(s, 0, 2)).otherwise(s).alias("text"))
    return A.parse_form(filled).select("paragraph_id", "document_id", "text_hash", F.array_join("checked_classes", ",").alias("classes"), "status")
