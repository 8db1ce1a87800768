"""Annotation files, validation, agreement and the gold standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import text_hash
from .corpus import number_rows

# The lines of the annotation form.
FORM_VERSION = 1
BOXES = ("0 — Não relevante", "1 — Definição ou conceituação", "2 — Fator determinante", "3 — Tipo ou dimensão", "4 — Relação causal", "5 — Característica ou propriedade")
HEADS = {"item": "## Trecho", "text": "### Texto", "marks": "### Classificação", "note": "### Observação opcional"}


def form_sections(paragraphs: DataFrame, hide_scores: bool = True, blind: bool = False) -> DataFrame:
    """One Markdown section per paragraph, numbered in order: (n, paragraph_id, section)."""
    paragraphs, n = number_rows(paragraphs, "n", "paragraph_id", start=1), F.col("n")
    boxes = "\n".join(f"- [ ] {b}" for b in BOXES)
    head = [F.concat(F.lit(HEADS["item"] + " "), n.cast("string"), F.lit("\n"))]
    if not blind:
        head.append(F.concat(F.lit("document_id: "), F.col("article_id").cast("string"), F.lit("  ")))
    head.append(F.concat(F.lit("paragraph_id: "), F.col("paragraph_id").cast("string"), F.lit("  ")))
    if not hide_scores:
        head.append(F.concat(F.lit("similarity_score: "), F.format_string("%.4f", F.col("semantic_score").cast("double")), F.lit("  ")))
    head.append(F.concat(F.lit("text_hash: "), text_hash("text"), F.lit("  \n")))
    body = [F.lit(HEADS["text"] + "\n"), F.concat(F.trim("text"), F.lit("\n")), F.lit(f"{HEADS['marks']}\n\n{boxes}\n"), F.lit(HEADS["note"] + "\n\n\n---\n")]
    return paragraphs.select(n.alias("n"), "paragraph_id", F.concat_ws("\n", *head, *body).alias("section"))


def form_header(dataset_id: str, run_id: str = "", concept: str = "", annotator: str = "", created_at: str = "") -> str:
    return f"---\nsld_annotation_format: {FORM_VERSION}\nrun_id: '{run_id}'\ndataset_id: {dataset_id}\nconcept: {concept}\ncreated_at: '{created_at}'\nannotator: '{annotator}'\n---\n\n"


def status_of(classes: Column, zero_conflicts: bool = True) -> Column:
    conflict = F.array_contains(classes, 0) & (F.size(classes) > 1) & F.lit(zero_conflicts)
    return F.when(F.size(classes) == 0, "unannotated").when(conflict, "invalid").otherwise("valid")


def parse_form(files: DataFrame) -> DataFrame:
    """files (text) -> paragraphs of filled-in forms, with their marks and status."""
    body = F.regexp_replace("text", "(?s)\\A---\\s*\\n.*?\\n---\\s*\\n", "")
    sec = files.select(F.explode(F.split(body, "\\n?##\\s+Trecho\\s+\\d+")).alias("sec"))
    take = lambda pattern: F.regexp_extract("sec", pattern, 1)
    sec = sec.withColumn("paragraph_id", take("paragraph_id:\\s*(\\S+)")).filter("paragraph_id <> ''")
    marks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("sec", F.lit("-\\s*\\[[xXvV*]\\]\\s*([0-5])"), F.lit(1)), lambda x: x.cast("int"))))
    score = take("similarity_score:\\s*([\\d.]+)")
    out = sec.select(
        "paragraph_id", take("document_id:\\s*(\\S+)").alias("document_id"), take("text_hash:\\s*(\\S+)").alias("text_hash"),
        F.when(score != "", score.cast("double")).alias("semantic_score"), F.trim(F.regexp_replace(take("(?s)###\\s+Texto\\s*\\n(.*?)(?=\\n###|\\z)"), "^\\s+|\\s+$", "")).alias("text"),
        marks.alias("checked_classes"), F.regexp_replace(take("(?s)###\\s+Observação opcional\\s*\\n(.*?)(?=\\n---|\\z)"), "^\\s+|\\s+$", "").alias("note"),
    )
    out = out.withColumn("status", status_of(F.col("checked_classes")))
    return out.withColumn("error", F.when(F.col("status") == "invalid", "class 0 with other classes"))


def validate_flags(rows: DataFrame) -> DataFrame:
    """Rows with label_0..label_5 (booleans), or legacy rows with labels (array<int>), to classes and status.  Legacy
    labels follow the class-0 rule first, so they never conflict."""
    flags = F.filter(F.array(*(F.when(F.coalesce(F.col(f"label_{i}"), F.lit(False)), F.lit(i)) for i in range(6))), lambda x: x.isNotNull())
    legacy = F.array(*(F.col(f"label_{i}") for i in range(6))).isNotNull() & F.expr(" and ".join(f"label_{i} is null" for i in range(6)))
    classes = F.when(legacy, L.sanitize(F.coalesce("labels", F.array().cast("array<int>")))).otherwise(flags)
    status = status_of(F.col("classes"))
    given = F.coalesce("annotation_status", F.lit("valid")) if "annotation_status" in rows.columns else F.lit("valid")
    return rows.withColumn("classes", classes).withColumn("status", F.when(status == "valid", given).otherwise(status))


def validate_csv(rows: DataFrame) -> DataFrame:
    """labels as text, split on ';' or ','; what is no integer is dropped; no class-0 rule."""
    parts = F.filter(F.transform(F.split(F.coalesce("labels", F.lit("")), "[;,]"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return rows.withColumn("classes", F.array_sort(F.array_distinct(parts))).withColumn("status", status_of(F.col("classes")))


def import_file(spark, path: str) -> DataFrame:
    """An annotation file by its extension: .jsonl (flags or legacy labels), .csv (labels as text), anything else a filled-in
    form -> paragraph_id, annotator_id, text_hash, classes, note, status.  Bad lines of JSON are left out."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if ext == "jsonl":
        flags = ", ".join(f"label_{i} boolean" for i in range(6))
        rows = spark.read.schema(f"paragraph_id string, annotator_id string, annotator string, text_hash string, text_sha256 string, {flags}, labels array<int>, annotation_status string, annotation_note string, annotation_notes string").option("mode", "DROPMALFORMED").json(path)
        rows = validate_flags(rows).withColumns({"annotator_id": F.coalesce("annotator_id", "annotator"), "text_hash": F.coalesce("text_hash", "text_sha256"), "note": F.coalesce("annotation_note", "annotation_notes")})
    elif ext == "csv":
        rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
        for c in ("annotator_id", "text_hash", "note", "labels"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        rows = validate_csv(rows)
    else:
        rows = parse_form(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))
        rows = rows.withColumn("classes", F.col("checked_classes")).withColumn("annotator_id", F.lit(None).cast("string"))
    rows = rows.filter(text("paragraph_id") != "")
    return rows.select("paragraph_id", text("annotator_id").alias("annotator_id"), text("text_hash").alias("text_hash"), "classes", text("note").alias("note"), "status")


def check_import(rows: DataFrame, corpus: DataFrame, existing: DataFrame) -> DataFrame:
    """Import rows (paragraph_id, annotator_id, text_hash, ..) against the corpus and what is already annotated."""
    known = corpus.groupBy("paragraph_id").agg(F.first("text_sha256").alias("_sha"))
    have = existing.select("paragraph_id", "annotator_id").distinct().withColumn("_have", F.lit(True))
    out = rows.join(known, "paragraph_id", "left").join(have, ["paragraph_id", "annotator_id"], "left")
    return out.select(
        *rows.columns, F.col("_sha").isNull().alias("unknown_paragraph"), F.coalesce(F.col("_sha") != F.col("text_hash"), F.lit(False)).alias("hash_differs"),
        F.coalesce("_have", F.lit(False)).alias("replaces"),
    )


def gold_standard(annotations: DataFrame, keep_negatives: bool = False) -> DataFrame:
    """Valid, included annotations; explicit negatives only if asked for."""
    out = annotations.filter("annotation_status = 'valid' and included_in_gold_standard")
    return out if keep_negatives else out.filter("not label_0")


def overview(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    a = annotations.agg(
        F.count_if(F.col("status") == "valid").alias("n_valid"), F.count_if((F.col("status") == "valid") & F.col("included")).alias("n_gold"),
        F.count_distinct("annotator_id").alias("n_annotators"), F.count_distinct("paragraph_id").alias("_seen"),
    )
    out = candidates.agg(F.count("*").alias("n_candidates")).crossJoin(a)  # one row each
    return out.withColumn("n_unannotated", F.greatest(F.lit(0).cast("long"), F.col("n_candidates") - F.col("_seen"))).drop("_seen")


def label_frequency(annotations: DataFrame) -> DataFrame:
    """Annotations per class and their share of all annotations."""
    n = annotations.agg(F.count("*").alias("_all"))
    out = annotations.select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(n)).select("class", "n", F.round(100.0 * F.col("n") / F.col("_all"), 2).alias("pct"))  # one row


def conflicts(annotations: DataFrame) -> DataFrame:
    """Paragraphs whose annotators' label sets differ."""
    out = annotations.groupBy("paragraph_id").agg(F.count_distinct(F.array_join(F.array_sort("classes"), ",")).alias("n_sets"), F.count_distinct("annotator_id").alias("n_annotators"))
    return out.filter("n_sets > 1")


def kappa_columns(a: str, b: str) -> list[Column]:
    """Observed and expected agreement and kappa of two 0/1 columns, as aggregates rounded to 4 places."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    po = F.avg((x == y).cast("double"))
    pe = F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))
    k = F.when(F.abs(1 - pe) < 1e-9, F.when(po > 1 - 1e-9, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return [F.count("*").alias("n"), F.round(po, 4).alias("p_o"), F.round(pe, 4).alias("p_e"), F.round(k, 4).alias("kappa")]


def annotator_pairs(annotations: DataFrame) -> DataFrame:
    """Of each paragraph the first record of its first two annotators (by seq): paragraph_id, classes_a, classes_b."""
    first = annotations.groupBy("paragraph_id", "annotator_id").agg(F.min_by("classes", "seq").alias("classes"), F.min("seq").alias("seq"))
    two = F.slice(F.array_sort(F.collect_list(F.struct("seq", "classes"))), 1, 2)  # one entry per annotator
    out = first.groupBy("paragraph_id").agg(two.alias("two")).filter(F.size("two") == 2)
    return out.select("paragraph_id", F.col("two")[0].classes.alias("classes_a"), F.col("two")[1].classes.alias("classes_b"))


def agreement(annotations: DataFrame) -> DataFrame:
    """Cohen's kappa of every class 0..5 over the annotator pairs."""
    pairs = annotator_pairs(annotations)
    long = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("class"), "classes_a", "classes_b")
    long = long.withColumn("a", F.array_contains("classes_a", F.col("class")).cast("int")).withColumn("b", F.array_contains("classes_b", F.col("class")).cast("int"))
    return long.groupBy("class").agg(*kappa_columns("a", "b"))


def macro_kappa(annotations: DataFrame) -> DataFrame:
    """The mean of the rounded kappas, summed as integers so that it doesn't depend on their order."""
    k = F.sum(F.round(F.col("kappa") * 10_000).cast("long")) / F.count("kappa")
    return agreement(annotations).agg((F.round(k) / 10_000).alias("macro_kappa"), F.max("n").alias("n_pairs"))


def adjudicate(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision (paragraph_id, classes, adjudicated_by) replaces its annotations' classes and marks them."""
    d = decisions.select("paragraph_id", F.col("classes").alias("_c"), F.col("adjudicated_by").alias("_by"))
    out = annotations.drop("adjudicated_by").join(d, "paragraph_id", "left")
    return out.withColumn("classes", F.coalesce("_c", "classes")).withColumn("adjudicated", F.col("_c").isNotNull()).withColumn("adjudicated_by", F.col("_by")).drop("_c", "_by")
