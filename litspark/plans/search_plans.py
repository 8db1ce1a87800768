"""Search, sampling and score queries: embeddings stand for paragraphs, ten to an article."""

from pyspark.sql import functions as F

from ..operators import sampling, search, views
from .registry import query, table

ANCHORS = (3, 57, 111, 222, 333)
WEIGHTS = (1.0, 2.0, 0.5, 1.0, 1.5)
BASE = """
WITH p AS (SELECT vec_id // 10 AS article_id, vec_id AS paragraph_id, embedding FROM embeddings WHERE vec_id % 37 <> 0),
a AS (SELECT 'Q' || row_number() OVER (ORDER BY vec_id) AS anchor_id, row_number() OVER (ORDER BY vec_id) AS pos, embedding AS v
  FROM embeddings WHERE vec_id IN (3, 57, 111, 222, 333)),
s AS (SELECT article_id, paragraph_id, anchor_id, pos, raw, round(raw, 6) AS s FROM (SELECT *, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS raw FROM p, a)),
"""
MAX = BASE + """
g AS (SELECT article_id, paragraph_id, max(s) AS aggregate_score, arg_max(anchor_id, {'s': s, 'n': -pos}) AS best_anchor_id FROM s GROUP BY ALL),
"""
RANKED = """
SELECT article_id, paragraph_id, aggregate_score, best_anchor_id, aggregate_score >= 0.2 AS selected,
  row_number() OVER (ORDER BY aggregate_score DESC, article_id, paragraph_id) AS rank FROM g
"""
COLUMNS = ("article_id", "paragraph_id", "aggregate_score", "best_anchor_id", "selected", "rank")


def paragraphs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    status = F.when(F.col("vec_id") % 37 == 0, "error").otherwise("valid_paragraph")
    return e.select(
        F.expr("vec_id div 10").alias("article_id"), F.col("vec_id").alias("paragraph_id"), (F.col("vec_id") % 10).cast("int").alias("chunk_index"), "embedding", status.alias("status"), "label"
    )


def anchors(spark, sf_dir):
    chosen = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(*ANCHORS))
    pos = sum(((F.col("vec_id") > a).cast("int") for a in ANCHORS), F.lit(0))
    return chosen.select(F.concat(F.lit("Q"), (pos + 1).cast("string")).alias("anchor_id"), pos.alias("pos"), F.get(F.array(*map(F.lit, WEIGHTS)), pos).alias("weight"), "embedding")


def scored(spark, sf_dir, strategy="maximum", threshold=0.2, **more):
    return search.multi_anchor_search(paragraphs(spark, sf_dir), anchors(spark, sf_dir), strategy, threshold, **more)


@query(MAX.rstrip().rstrip(",") + RANKED)
def multi_anchor_max(spark, sf_dir):
    return scored(spark, sf_dir).select(*COLUMNS)


@query(BASE + "g AS (SELECT article_id, paragraph_id, round(sum(raw ORDER BY pos) / count(*), 6) AS aggregate_score, arg_max(anchor_id, {'s': s, 'n': -pos}) AS best_anchor_id FROM s GROUP BY ALL)" + RANKED)
def multi_anchor_mean(spark, sf_dir):
    return scored(spark, sf_dir, "mean").select(*COLUMNS)


@query(BASE + "g AS (SELECT article_id, paragraph_id, round(sum(raw * [1.0, 2.0, 0.5, 1.0, 1.5][pos]::DOUBLE ORDER BY pos) / 6.0::DOUBLE, 6) AS aggregate_score, arg_max(anchor_id, {'s': s, 'n': -pos}) AS best_anchor_id FROM s GROUP BY ALL)" + RANKED)
def multi_anchor_weighted(spark, sf_dir):
    return scored(spark, sf_dir, "weighted_mean").select(*COLUMNS)


@query(BASE + """
u AS (SELECT pos, unnest(range(1, 65)) AS d, v FROM a),
c AS (SELECT list(x ORDER BY d) AS center FROM (SELECT d, avg(v[d]::DOUBLE / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS x FROM u GROUP BY d)),
b AS (SELECT article_id, paragraph_id, arg_max(anchor_id, {'s': s, 'n': -pos}) AS best_anchor_id FROM s GROUP BY ALL),
g AS (SELECT b.*, round(list_cosine_similarity(embedding::DOUBLE[], center), 6) AS aggregate_score FROM b JOIN p USING (article_id, paragraph_id), c)
""" + RANKED)
def multi_anchor_centroid(spark, sf_dir):
    return scored(spark, sf_dir, "centroid").select(*COLUMNS)


@query(MAX + "r AS (SELECT * FROM g ORDER BY aggregate_score DESC, article_id, paragraph_id LIMIT 10) SELECT article_id, paragraph_id, aggregate_score, CAST(row_number() OVER (ORDER BY aggregate_score DESC, article_id, paragraph_id) AS INT) AS rank FROM r")
def search_topk(spark, sf_dir):
    return search.top_k(paragraphs(spark, sf_dir), anchors(spark, sf_dir), 10).select("article_id", "paragraph_id", "aggregate_score", "rank")


@query(MAX.rstrip().rstrip(",") + "SELECT article_id, paragraph_id, aggregate_score, row_number() OVER (ORDER BY aggregate_score DESC, article_id, paragraph_id) AS rank FROM g WHERE article_id IN (1, 5, 7, 20, 33) AND aggregate_score >= 0.05")
def search_article_filter(spark, sf_dir):
    out = scored(spark, sf_dir, threshold=0.05, articles=[1, 5, 7, 20, 33], only_retained=True)
    return out.select("article_id", "paragraph_id", "aggregate_score", "rank")


@query(MAX.rstrip().rstrip(",") + """
SELECT count(*) AS n_total, count(*) FILTER (aggregate_score >= 0.2) AS n_retained, count(*) FILTER (aggregate_score < 0.2) AS n_discarded,
  round(100.0::DOUBLE * count(*) FILTER (aggregate_score >= 0.2) / count(*), 4) AS retention_pct,
  round(avg(aggregate_score) FILTER (aggregate_score >= 0.2), 4) AS mean_score, round(median(aggregate_score) FILTER (aggregate_score >= 0.2), 4) AS median_score,
  round(min(aggregate_score) FILTER (aggregate_score >= 0.2), 4) AS min_score, round(max(aggregate_score) FILTER (aggregate_score >= 0.2), 4) AS max_score FROM g
""")
def search_summary(spark, sf_dir):
    return search.summary(scored(spark, sf_dir, ranked=False))


@query(MAX.rstrip().rstrip(",") + """
SELECT anchor_id, round(avg(s), 4) AS mean_score, round(median(s), 4) AS median_score, round(min(s), 4) AS min_score, round(max(s), 4) AS max_score,
  round(stddev_pop(s), 4) AS std_score, count(DISTINCT paragraph_id) FILTER (s >= 0.2) AS n_paragraphs, count(DISTINCT article_id) FILTER (s >= 0.2) AS n_documents,
  count(*) FILTER (anchor_id = best_anchor_id) AS times_best,
  round(100.0::DOUBLE * count(DISTINCT paragraph_id) FILTER (s >= 0.2) / (SELECT count(DISTINCT paragraph_id) FROM p), 2) AS pct_paragraphs,
  round(100.0::DOUBLE * count(DISTINCT article_id) FILTER (s >= 0.2) / (SELECT count(DISTINCT article_id) FROM p), 2) AS pct_documents
FROM s JOIN g USING (article_id, paragraph_id) GROUP BY anchor_id
""")
def per_anchor_stats(spark, sf_dir):
    return search.per_anchor_statistics(scored(spark, sf_dir, ranked=False), 0.2)


@query(MAX.rstrip().rstrip(",") + """
SELECT i / 50.0::DOUBLE AS threshold, count(*) FILTER (aggregate_score >= i / 50.0::DOUBLE) AS retained,
  round(100.0::DOUBLE * count(*) FILTER (aggregate_score >= i / 50.0::DOUBLE) / count(*), 4) AS pct
FROM g, range(0, 51) r(i) GROUP BY i
""")
def sensitivity_curve(spark, sf_dir):
    return search.sensitivity_curve(scored(spark, sf_dir, ranked=False))


@query(MAX.rstrip().rstrip(",") + "SELECT CAST(least(greatest(floor((aggregate_score + 0.2) / (1.2 / 30)), 0), 29) AS INT) AS bin, count(*) AS n FROM g GROUP BY 1")
def score_histogram(spark, sf_dir):
    return search.histogram(scored(spark, sf_dir, ranked=False), "aggregate_score", 30, -0.2, 1.0)


@query(MAX.rstrip().rstrip(",") + """
SELECT count(*) AS n, round(avg(aggregate_score), 4) AS mean, round(median(aggregate_score), 4) AS median, round(coalesce(stddev_samp(aggregate_score), 0), 4) AS std,
  round(min(aggregate_score), 4) AS min, round(max(aggregate_score), 4) AS max, round(quantile_cont(aggregate_score, 0.25), 4) AS p25,
  round(quantile_cont(aggregate_score, 0.75), 4) AS p75 FROM g
""")
def score_describe(spark, sf_dir):
    return search.describe(scored(spark, sf_dir, ranked=False), "aggregate_score")


CHUNKS = MAX + "c AS (SELECT article_id, paragraph_id // 2 AS paragraph_id, CAST(paragraph_id % 10 AS INT) AS chunk_index, aggregate_score, best_anchor_id FROM g)"


def _chunked(spark, sf_dir):
    return scored(spark, sf_dir, ranked=False).select("article_id", F.expr("paragraph_id div 2").alias("paragraph_id"), "chunk_index", "aggregate_score", "best_anchor_id")


@query(CHUNKS + "SELECT article_id, paragraph_id, arg_max(chunk_index, {'s': aggregate_score, 'n': -chunk_index}) AS chunk_index, max(aggregate_score) AS aggregate_score, arg_max(best_anchor_id, {'s': aggregate_score, 'n': -chunk_index}) AS best_anchor_id FROM c GROUP BY 1, 2")
def chunk_consolidate_max(spark, sf_dir):
    return search.consolidate_chunks(_chunked(spark, sf_dir))


@query(CHUNKS + "SELECT article_id, paragraph_id, arg_max(chunk_index, {'s': aggregate_score, 'n': -chunk_index}) AS chunk_index, round(avg(aggregate_score), 9) AS aggregate_score, arg_max(best_anchor_id, {'s': aggregate_score, 'n': -chunk_index}) AS best_anchor_id FROM c GROUP BY 1, 2")
def chunk_consolidate_mean(spark, sf_dir):
    return search.consolidate_chunks(_chunked(spark, sf_dir), "mean")


@query("""
SELECT conv_id AS article_id, turn AS idx, length(lag(text) OVER w) AS before_chars, length(lead(text) OVER w) AS after_chars,
  sha256(coalesce(lag(text) OVER w, '')) AS before_sha, sha256(coalesce(lead(text) OVER w, '')) AS after_sha
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def adjacent_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("idx"), "text")
    rows = search.adjacent(rows)
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return rows.select(
        "article_id", "idx", F.length("context_before").cast("long").alias("before_chars"), F.length("context_after").cast("long").alias("after_chars"),
        sha("context_before").alias("before_sha"), sha("context_after").alias("after_sha"),
    )


ORDER = "ORDER BY md5('42|' || paragraph_id), paragraph_id"


@query(f"SELECT vec_id AS paragraph_id FROM (SELECT *, vec_id AS paragraph_id FROM embeddings WHERE vec_id % 37 <> 0) {ORDER} LIMIT 30")
def sample_random(spark, sf_dir):
    return sampling.random_sample(search.valid_segments(paragraphs(spark, sf_dir)), 30, "paragraph_id").select("paragraph_id")


@query(MAX + f"""
t AS (SELECT *, CASE WHEN aggregate_score >= 0 THEN (aggregate_score >= 0)::INT + (aggregate_score >= 0.4)::INT + (aggregate_score >= 0.6)::INT + (aggregate_score >= 0.75)::INT END AS st FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY st {ORDER}) AS nth FROM t)
SELECT paragraph_id, aggregate_score FROM n ORDER BY NOT (st IS NOT NULL AND nth <= 5), md5('42|' || paragraph_id), paragraph_id LIMIT 20
""")
def sample_stratified(spark, sf_dir):
    return sampling.stratified_sample(scored(spark, sf_dir, ranked=False), 20, "aggregate_score", "paragraph_id").select("paragraph_id", "aggregate_score")


@query(MAX + f"""
e AS (SELECT min(aggregate_score) AS lo, max(aggregate_score) AS hi FROM g),
t AS (SELECT *, least(floor((aggregate_score - lo) / ((hi - lo) / 5)), 4) AS st FROM g, e),
n AS (SELECT *, row_number() OVER (PARTITION BY st {ORDER}) AS nth FROM t)
SELECT paragraph_id, aggregate_score FROM n ORDER BY nth > 6, md5('42|' || paragraph_id), paragraph_id LIMIT 30
""")
def sample_by_similarity(spark, sf_dir):
    return sampling.stratified_by_similarity(scored(spark, sf_dir, ranked=False), 30, "aggregate_score", "paragraph_id").select("paragraph_id", "aggregate_score")


@query(MAX.rstrip().rstrip(",") + f"SELECT paragraph_id, aggregate_score FROM g WHERE round(abs(aggregate_score - 0.2), 9) <= 0.05 {ORDER} LIMIT 30")
def sample_boundary(spark, sf_dir):
    return sampling.boundary_sample(scored(spark, sf_dir, ranked=False), 30, "aggregate_score", "paragraph_id", 0.2).select("paragraph_id", "aggregate_score")


@query(MAX.rstrip().rstrip(",") + "SELECT paragraph_id, aggregate_score FROM g ORDER BY aggregate_score DESC, paragraph_id LIMIT 25")
def sample_topk(spark, sf_dir):
    return sampling.top_sample(scored(spark, sf_dir, ranked=False), 25, "aggregate_score", "paragraph_id").select("paragraph_id", "aggregate_score")


@query(BASE + "u AS (SELECT paragraph_id, round(avg(abs((1 + s) / 2 - 0.5)), 6) AS uncertainty FROM s GROUP BY 1) SELECT * FROM u ORDER BY uncertainty, paragraph_id LIMIT 25")
def sample_uncertainty(spark, sf_dir):
    p = scored(spark, sf_dir, ranked=False).withColumn("probabilities", F.transform_values("anchor_scores", lambda k, v: (1 + v) / 2))
    return sampling.uncertainty_sample(p, 25, "probabilities", "paragraph_id").select("paragraph_id", "uncertainty")


@query(f"SELECT vec_id AS paragraph_id FROM (SELECT *, vec_id AS paragraph_id FROM embeddings) WHERE vec_id NOT IN (SELECT doc_id FROM labels) {ORDER} LIMIT 30")
def sample_unannotated(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paragraph_id"))
    return sampling.unannotated_sample(paragraphs(spark, sf_dir), done, 30, "paragraph_id").select("paragraph_id")


@query(BASE + "x AS (SELECT 1) SELECT e.vec_id AS paragraph_id, round(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS norm2, round(list_dot_product(e.embedding::DOUBLE[], a.v::DOUBLE[]), 4) AS dot FROM embeddings e JOIN a ON a.pos = 1")
def vector_products(spark, sf_dir):
    from ..functions.vectors import dot

    one = anchors(spark, sf_dir).filter("pos = 0").select(F.col("embedding").alias("v"))
    e = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(one))  # one row
    return e.select(F.col("vec_id").alias("paragraph_id"), F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"), F.round(dot(F.col("embedding"), F.col("v")), 4).alias("dot"))


@query(MAX.rstrip().rstrip(",") + """, v AS (SELECT article_id, paragraph_id, aggregate_score AS semantic_score, aggregate_score >= 0.2 AS selected FROM g)
SELECT * FROM v WHERE semantic_score >= 0.05 AND selected = false ORDER BY semantic_score DESC, article_id, paragraph_id LIMIT 100""")
def candidate_view(spark, sf_dir):
    """The best rows that a threshold of 0.2 leaves out: a filtered view of a hundred rows."""
    rows = scored(spark, sf_dir, ranked=False).select("article_id", "paragraph_id", F.col("aggregate_score").alias("semantic_score"), "selected")
    return views.view(rows.filter(~F.col("selected")), min_score=0.05, show=100)


@query(MAX.rstrip().rstrip(",") + """, r AS (SELECT CASE WHEN paragraph_id % 3 = 0 THEN -1 - article_id ELSE article_id END AS article_id, paragraph_id, aggregate_score FROM g WHERE paragraph_id % 5 <> 0),
c AS (SELECT vec_id // 10 AS article_id, vec_id AS paragraph_id FROM embeddings)
SELECT c.article_id, c.paragraph_id, coalesce(o.aggregate_score, f.aggregate_score, 0.0::DOUBLE) AS semantic_score FROM c LEFT JOIN r o ON o.article_id = c.article_id AND o.paragraph_id = c.paragraph_id LEFT JOIN r f ON f.paragraph_id = c.paragraph_id""")
def corpus_scores(spark, sf_dir):
    """Scores of a search brought to the corpus: by article and paragraph, else by paragraph (a third lies under another
    article), else 0 (a fifth was not searched)."""
    found = scored(spark, sf_dir).filter("paragraph_id % 5 <> 0")
    found = found.withColumn("article_id", F.when(F.col("paragraph_id") % 3 == 0, -1 - F.col("article_id")).otherwise(F.col("article_id")))
    corpus = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("article_id"), F.col("vec_id").alias("paragraph_id"))
    return search.attach_scores(corpus, found)
