"""Queries of tracked runs, audited versions, registry look-ups and item states."""

from pyspark.sql import functions as F

from ..operators import audit, progress, registry_store
from ..sources.shared import new_path
from ..streaming import checkpoints
from .registry import query, table
from .search_plans import MAX, scored


@query(MAX.rstrip().rstrip(",") + " SELECT count(*) AS rows, count(*) FILTER (aggregate_score >= 0.1) AS kept, count(*) FILTER (aggregate_score < 0.1) AS discarded FROM g")
def observed_search(spark, sf_dir):
    """A tracked search: its rows are counted in the job that writes them."""
    found = scored(spark, sf_dir)
    run = progress.start_write(found, new_path(spark, "observed"), F.col("aggregate_score") >= 0.1)
    seen = run.wait()
    return spark.range(1).select(*(F.lit(seen[c]).cast("long").alias(c) for c in ("rows", "kept", "discarded")))


AUDITED = """
WITH a AS (SELECT doc_id AS id, quality, toxic FROM labels),
b AS (SELECT id, CASE WHEN id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM a WHERE id % 10 <> 3 UNION ALL SELECT -1 - id, quality, toxic FROM a WHERE id % 11 = 0)
"""


@query(AUDITED + """SELECT coalesce(a.id, b.id) AS doc_id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS op, a.quality AS quality_before, b.quality AS quality_after, 2 AS version
FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.quality <> b.quality OR a.toxic <> b.toxic""")
def annotation_audit(spark, sf_dir):
    """Two versions of the labels: the second one's entries in the log."""
    path = _audited(spark, sf_dir)
    log = audit.audit_log(spark, path).filter("version = 2")
    return log.select("doc_id", "op", F.col("before.quality").alias("quality_before"), F.col("after.quality").alias("quality_after"), "version")


@query(AUDITED + "SELECT id AS doc_id, quality, toxic FROM b")
def audit_replay(spark, sf_dir):
    """The labels' second version, as its log alone gives it."""
    return audit.replay(spark, _audited(spark, sf_dir)).select("doc_id", "quality", "toxic")


def _audited(spark, sf_dir):
    path, one = new_path(spark, "audited"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    two = one.filter("doc_id % 10 <> 3").withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    two = two.unionByName(one.filter("doc_id % 11 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    audit.save(one, path, ["doc_id"], "ann", "2024-01-01 00:00:00")
    audit.save(two.select(one.columns), path, ["doc_id"], "bob", "2024-01-02 00:00:00", "adjudicate")
    return path


@query("""
WITH r AS (SELECT doc_id AS article_id, sha256(coalesce(text, '')) AS h, source || '-' || (doc_id // 2) AS f FROM documents)
SELECT 'hash' AS found_by, article_id FROM r WHERE h IN (SELECT sha256(text) FROM benchmark UNION SELECT h FROM r WHERE article_id % 25 = 0)
UNION ALL SELECT 'name', article_id FROM r WHERE f IN (SELECT f FROM r WHERE article_id % 25 = 0)
""")
def registry_lookup(spark, sf_dir):
    """Articles found by content (of other documents and benchmark items) and by file name."""
    name = F.concat(F.col("source"), F.lit("-"), F.expr("doc_id div 2").cast("string"))
    reg = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("pdf_sha256"), name.alias("source_filename"))
    path = new_path(spark, "registry")
    registry_store.save(reg, path)
    asked = reg.filter("article_id % 25 = 0")
    hashes = asked.select("pdf_sha256").unionByName(table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("pdf_sha256")))
    by_hash = registry_store.find_all(hashes, path, "pdf_sha256").select(F.lit("hash").alias("found_by"), "article_id")
    return by_hash.unionByName(registry_store.find_all(asked, path, "source_filename").select(F.lit("name").alias("found_by"), "article_id"))


@query("""
WITH e AS (SELECT event_type AS operation_id, CAST(user_id AS VARCHAR) AS item_key, CASE WHEN value > 50 THEN 'ok' WHEN value > 20 THEN 'started' ELSE 'error' END AS event, ts, event_id FROM events),
l AS (SELECT operation_id, item_key, arg_max(event, {'t': ts, 'e': event_id}) AS event, max(ts) AS last, count(*) FILTER (event = 'error') AS errors, count(*) FILTER (event = 'ok') AS oks FROM e GROUP BY 1, 2),
m AS (SELECT max(ts) AS top FROM events)
SELECT operation_id, item_key, CASE WHEN event = 'ok' THEN 'completed' WHEN event = 'error' AND errors >= 3 THEN 'failed' WHEN epoch_ms(last) + 3600000 < epoch_ms(top) THEN 'interrupted' ELSE 'active' END AS state,
  errors, oks FROM l, m
""")
def item_states(spark, sf_dir):
    """Every user's item of every operation after all events, by a stream over the table's files."""
    events = f"{sf_dir}/events.parquet*"  # a pattern, as a stream reads folders
    kind = F.when(F.col("value") > 50, "ok").when(F.col("value") > 20, "started").otherwise("error")
    rows = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    rows = rows.select(F.col("event_type").alias("operation_id"), F.col("user_id").alias("item_key"), kind.alias("event"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit("").alias("message"))
    base = new_path(spark, "items")
    checkpoints.track(spark, rows, f"{base}/changes", f"{base}/checkpoint", 3, "1 hour", "0 seconds")
    states = checkpoints.item_states(spark.read.parquet(f"{base}/changes"))
    return states.select("operation_id", "item_key", "state", F.col("errors").cast("long").alias("errors"), F.col("oks").cast("long").alias("oks"))
