"""A training corpus from documents: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir); between stages the documents are a Parquet table in the shared folder.

What holds for every stage: rows without doc_id are left out; a null text counts as an empty one and may
come back as one, other untouched texts stay as they are; rows that repeat a doc_id are rows of their own; columns other than doc_id, text, lang, source and n_chars are
dropped, whatever their names; an empty table gives an empty one; no order of rows matters to what stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.llm import bpe, mixing, ngram_jaccard, quality_cotrain, substring_dedup
from litspark.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.  Without labels of both kinds all stay; null metadata are a
    value of their own."""
    return quality_cotrain.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity the document with the smallest id stays, with all rows of that id.
    Documents without words are linked with nothing and stay."""
    found = ngram_jaccard.jaccard_join(docs)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go from all but their first place (smallest doc_id, then first words); other documents keep
    their text as it is.  n_chars is counted anew; a document of which nothing is left stays with an empty text."""
    kept = substring_dedup.dedup_substrings(docs, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes its words, to the nearest whole time.  Rows without words are taken no
    time; a null source is a source; copies of a row are equal rows."""
    # rows that repeat a doc_id are told apart by source, size and, where these agree too, by their order
    key = ("doc_id", "from_source", "size")
    nth = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    source = F.struct(F.col("source").cast("string").alias("source")).alias("from_source")
    mixed = mixing.mix(docs).select("doc_id", source, "size", "taken").withColumn("nth", nth(F.desc("taken")))
    times = mixed.filter("taken > 0").withColumn("times", F.expr("(2 * taken + size) div (2 * size)").cast("int"))
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD_CLASS)), F.lit(0)).cast("long")
    rows = docs.select(*COLUMNS, source, size.alias("size")).withColumn("nth", nth("text", "lang", "n_chars"))
    rows = rows.join(times.filter("times > 0"), [*key, "nth"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoded text, a row for every row."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources", source_mixing),
    ("BPE encoding", bpe_tokens),
]

#: Co-training and the tokenizer cannot be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
