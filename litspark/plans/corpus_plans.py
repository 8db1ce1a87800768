"""Registry, upsert, integrity, funnel and operation-log queries."""

from pyspark.sql import functions as F

from ..operators import corpus, extract, sampling
from .registry import query, table

BATCH = """
WITH r AS (SELECT 'A' || doc_id AS article_id, 'f' || doc_id % 400 AS source_filename, sha256(text) AS pdf_sha256, CAST(1 + doc_id % 3 AS INT) AS version_number FROM documents),
b AS (SELECT 'f' || doc_id % 700 AS source_filename, sha256(text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' v2' END) AS pdf_sha256 FROM documents),
h AS (SELECT pdf_sha256, min(article_id) AS same FROM r GROUP BY 1), n AS (SELECT source_filename, min(article_id) AS named FROM r GROUP BY 1),
c AS (SELECT b.source_filename, b.pdf_sha256, CASE WHEN same IS NOT NULL THEN 'duplicate' WHEN named IS NOT NULL THEN 'modified' ELSE 'new' END AS kind, coalesce(same, named) AS matches
  FROM b LEFT JOIN h USING (pdf_sha256) LEFT JOIN n USING (source_filename))
"""


def registry(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("concat('A', doc_id) article_id", "concat('f', doc_id % 400) source_filename", "sha2(text, 256) pdf_sha256", "cast(1 + doc_id % 3 as int) version_number")


def batch(spark, sf_dir):
    """All documents again: a third unchanged, the others with another text, some under names not yet known."""
    text = "concat(text, case when doc_id % 3 = 0 then '' else ' v2' end)"
    return table(spark, sf_dir, "documents").selectExpr("concat('f', doc_id % 700) source_filename", f"sha2({text}, 256) pdf_sha256")


@query(BATCH + "SELECT * FROM c")
def duplicate_batch_classify(spark, sf_dir):
    return corpus.classify_batch(batch(spark, sf_dir), registry(spark, sf_dir))


@query(BATCH + "SELECT c.source_filename, kind, CAST(CASE WHEN kind = 'new' THEN 1 ELSE version_number + 1 END AS INT) AS version_number, CASE WHEN kind <> 'new' THEN matches END AS supersedes FROM c LEFT JOIN r ON article_id = matches")
def version_chain(spark, sf_dir):
    reg = registry(spark, sf_dir)
    return corpus.next_versions(corpus.classify_batch(batch(spark, sf_dir), reg), reg)


@query("WITH n AS (SELECT doc_id + 1 AS doc_id, source FROM documents) SELECT doc_id, source, 'new' AS status FROM n UNION ALL SELECT doc_id, source, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def registry_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = d.withColumn("doc_id", F.col("doc_id") + 1).withColumn("status", F.lit("new"))
    return corpus.upsert(d.withColumn("status", F.lit("old")), new, "doc_id")


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return corpus.latest(e, ["user_id"], "ts", "event_id").select("user_id", "event_type", "ts")


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


SLICE_ROWS = 16


def _tree(digits: int) -> str:
    """SQL of the hash tree with prefixes of so many digits."""
    level = f"(SELECT h[:{digits}] AS p, h AS k, h || ':' || n AS v FROM h)"
    for d in range(digits, 0, -1):
        level = f"(SELECT p[:{d - 1}] AS p, p AS k, sha256(string_agg(v, '' ORDER BY k)) AS v FROM {level} GROUP BY p)"
    most, least = SLICE_ROWS * 16**digits, SLICE_ROWS * 16 ** (digits - 1) if digits else -1
    return f"SELECT sha256(string_agg(v, '' ORDER BY k)) AS corpus_hash, (SELECT CAST(sum(n) AS BIGINT) FROM h) AS n FROM {level} WHERE (SELECT count(*) FROM h) BETWEEN {least + 1} AND {most} HAVING count(*) > 0"


@query("WITH h AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) " + " UNION ALL ".join(map(_tree, range(6))))
def corpus_hash(spark, sf_dir):
    """Leaves of 16 hashes, so that the tree has levels on small tables, too."""
    return corpus.corpus_hash(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256")), slice_rows=SLICE_ROWS)


@query("""
WITH s AS (SELECT doc_id AS k FROM documents), v AS (SELECT vec_id AS k FROM embeddings)
SELECT (SELECT count(*) FROM s) AS n_segments, (SELECT count(*) FROM v) AS n_vectors, CAST(0 AS BIGINT) AS duplicate_segments, CAST(0 AS BIGINT) AS duplicate_vectors,
  (SELECT count(*) FROM s WHERE k NOT IN (SELECT k FROM v)) AS segments_without_vector, (SELECT count(*) FROM v WHERE k NOT IN (SELECT k FROM s)) AS vectors_without_segment, 'inconsistent' AS status
""")
def integrity_counts(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"))
    return corpus.integrity(s, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id")))


@query("SELECT doc_id AS article_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def resume_pending(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    return corpus.pending(a, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id")))


@query("""
WITH l AS (SELECT user_id, event_type, arg_max(value > 50, {'t': ts, 'e': event_id}) AS ok FROM events GROUP BY ALL),
p AS (SELECT DISTINCT user_id, event_type FROM events UNION SELECT DISTINCT -1 - user_id, event_type FROM events), j AS (SELECT p.event_type AS operation_id, ok FROM p LEFT JOIN l USING (user_id, event_type))
SELECT operation_id, count(*) AS total_items, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS pending,
  CASE WHEN count(*) FILTER (ok IS NULL) = 0 THEN 'completed' ELSE 'active' END AS state FROM j GROUP BY 1
""")
def checkpoint_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation_id"), F.col("user_id").alias("item_key"), (F.col("value") > 50).alias("ok"), F.struct("ts", "event_id").alias("at"))
    done = e.select("operation_id", "item_key")
    planned = done.unionByName(done.withColumn("item_key", -1 - F.col("item_key"))).distinct()  # as many are still pending
    return corpus.checkpoint_state(e, planned)


@query("""
WITH d AS (SELECT count(*) AS n FROM documents), e AS (SELECT count(DISTINCT text) AS n FROM documents), g AS (SELECT count(*) AS n FROM labels), h AS (SELECT count(*) AS n FROM labels WHERE quality = 1 AND toxic = 0),
s AS (SELECT 0 AS step, 'deduplicated' AS stage, d.n AS n_in, e.n AS n_out FROM d, e UNION ALL SELECT 1, 'annotated', e.n, g.n FROM e, g UNION ALL SELECT 2, 'relevant', g.n, h.n FROM g, h)
SELECT *, n_in - n_out AS removed, round(100.0::DOUBLE * n_out / n_in, 2) AS retention_pct FROM s
""")
def funnel(spark, sf_dir):
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = d.select(F.sha2("text", 256).alias("h")).distinct()
    return corpus.funnel(spark, [("deduplicated", d, one), ("annotated", one, g), ("relevant", g, g.filter("quality = 1 and toxic = 0"))])


@query("SELECT lang AS status, count(*) AS n FROM documents GROUP BY 1")
def status_counts(spark, sf_dir):
    return corpus.status_counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT round(1.0::DOUBLE - sum(n_chars)::DOUBLE / sum(length(text) * 3 + 7), 4) AS reduction FROM documents")
def size_reduction(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.size_reduction(d.select(F.col("n_chars").alias("md_chars"), (F.length("text") * 3 + 7).cast("long").alias("pdf_bytes")))


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 3) AS gap, 6.0::DOUBLE AS min_interval FROM events")
def rate_interval(spark, sf_dir):
    from pyspark.sql import Window

    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = F.round(s - F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 3)
    return table(spark, sf_dir, "events").select("event_id", gap.alias("gap"), F.lit(extract.min_interval(10.0)).alias("min_interval"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS faiss_id FROM documents")
def contiguous_ids(spark, sf_dir):
    return corpus.number_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "faiss_id", "n_chars", "doc_id").select("doc_id", "faiss_id")


@query("SELECT doc_id, (CASE WHEN doc_id % 4 = 0 THEN 'FINAL_CORPUS' WHEN doc_id % 4 = 1 THEN 'MODEL_RELEVANT' WHEN doc_id % 4 = 2 THEN 'MODEL_NOT_RELEVANT' ELSE 'RAW' END) AS status FROM documents WHERE doc_id % 4 < 2")
def final_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "element_at(array('FINAL_CORPUS', 'MODEL_RELEVANT', 'REJECTED', 'RAW'), cast(doc_id % 4 + 1 as int)) status")
    return corpus.final_corpus(d)


@query("""
WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS k, count(*) OVER () AS n FROM g),
c AS (SELECT *, ceil(round(n * 0.30000000000000004, 6)) AS held FROM r)
SELECT doc_id, CASE WHEN n < 3 OR k <= n - held THEN 'train' WHEN held < 2 THEN 'test' WHEN k <= n - ceil(round(held * 0.5, 6)) THEN 'val' ELSE 'test' END AS split FROM documents JOIN c USING (source)
""")
def group_split(spark, sf_dir):
    return sampling.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query("""
WITH t AS (SELECT * FROM documents WHERE doc_id % 3 > 0), e AS (SELECT * FROM documents WHERE doc_id % 3 = 0)
SELECT 'paragraph_id' AS kind, CAST(0 AS BIGINT) AS shared, false AS alert
UNION ALL SELECT 'text', count(*), count(*) > 0 FROM (SELECT trim(text) FROM t INTERSECT SELECT trim(text) FROM e)
UNION ALL SELECT 'article_id', count(*), count(*) > 0 FROM (SELECT source FROM t INTERSECT SELECT source FROM e)
""")
def leakage_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paragraph_id"), "text", F.col("source").alias("article_id"), "doc_id")
    return sampling.leakage(d.filter("doc_id % 3 > 0"), d.filter("doc_id % 3 = 0"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def operation_windows(spark, sf_dir):
    from ..streaming.incremental import event_counts

    out = event_counts(table(spark, sf_dir, "events"))
    return out.select("event_type", F.col("window.start").alias("start"), "n", F.round("value", 2).alias("value"))
