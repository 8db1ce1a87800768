"""Calibration and evaluation queries.

Multilabel items come from labels: y and probabilities are whole-number functions of the row, so both sides agree exactly.
"""

from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from ..operators import evaluate as E
from .registry import ORACLE_SQL, query, table
from .search_plans import MAX, scored

RESULTS = MAX + """
r AS (SELECT paragraph_id, round((1 + aggregate_score) / 2, 6) AS aggregate_score, row_number() OVER (ORDER BY aggregate_score DESC, article_id, paragraph_id) AS rank FROM g),
j AS (SELECT r.*, quality AS human_label FROM r JOIN labels ON doc_id = paragraph_id),
"""
GRID = RESULTS + """
t AS (SELECT (20 + 2 * i) / 100.0::DOUBLE AS threshold FROM range(38) x(i)),
c AS (SELECT threshold, count(*) FILTER (aggregate_score >= threshold AND human_label = 1) AS tp, count(*) FILTER (aggregate_score >= threshold AND human_label = 0) AS fp,
  count(*) FILTER (aggregate_score < threshold AND human_label = 1) AS fn, count(*) FILTER (aggregate_score < threshold AND human_label = 0) AS tn FROM j, t GROUP BY 1),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rc FROM c),
m AS (SELECT *, coalesce(2 * p * rc / nullif(p + rc, 0), 0) AS f FROM q),
"""


def unit_score():
    return E.scaled_round((1 + F.col("aggregate_score")) / 2, 6).alias("aggregate_score")


def results(spark, sf_dir, ranked=False):
    out = scored(spark, sf_dir, ranked=ranked)
    return out.select("paragraph_id", unit_score(), *(["rank"] if ranked else []))


def gold(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paragraph_id"), F.col("quality").alias("human_label"))


@query(GRID + """
n AS (SELECT threshold, count(*) FILTER (aggregate_score >= threshold) AS retrieved FROM r, t GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(p, 4) AS precision, round(rc, 4) AS recall, round(f, 4) AS f1, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 4) AS specificity,
  round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 4) AS accuracy, retrieved FROM m JOIN n USING (threshold)
""")
def threshold_metrics_grid(spark, sf_dir):
    return E.threshold_grid(results(spark, sf_dir), gold(spark, sf_dir))


@query(GRID + """
k AS (SELECT *, round(rc, 4) AS r4, round(f, 4) AS f4 FROM m)
SELECT threshold, round(p, 4) AS precision, r4 AS recall, f4 AS f1, true AS calibrated FROM k
ORDER BY r4 >= 0.9 DESC, CASE WHEN r4 >= 0.9 THEN f4 ELSE r4 END DESC, threshold LIMIT 1
""")
def calibrate_threshold(spark, sf_dir):
    return E.calibrate(results(spark, sf_dir), gold(spark, sf_dir))


@query(RESULTS + """
o AS (SELECT *, row_number() OVER (ORDER BY rank) AS pos, sum(human_label) OVER (ORDER BY rank) AS hits, row_number() OVER (ORDER BY human_label DESC, rank) AS ideal FROM j),
tot AS (SELECT sum(quality) AS n FROM labels)
SELECT round(count(*) FILTER (pos <= 10 AND human_label = 1) / least(count(*), 10)::DOUBLE, 4) AS precision_at_k, round(count(*) FILTER (pos <= 10 AND human_label = 1) / max(n)::DOUBLE, 4) AS recall_at_k,
  round(1.0::DOUBLE / min(pos) FILTER (human_label = 1), 4) AS mrr, round(sum(hits::DOUBLE / pos) FILTER (human_label = 1) / max(n), 4) AS map,
  round(sum((2 ** human_label - 1) / log2(pos + 1)) FILTER (pos <= 10) / sum((2 ** human_label - 1) / log2(ideal + 1)) FILTER (ideal <= 10), 4) AS ndcg FROM o, tot
""")
def ir_ranking_metrics(spark, sf_dir):
    return E.ranking_metrics(results(spark, sf_dir, ranked=True), gold(spark, sf_dir))


Y = ("quality", "toxic", "cast(doc_id % 3 = 0 as int)", "cast(doc_id % 7 = 2 as int)", "cast(quality * (doc_id % 2) as int)")
LONG = "WITH long AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS id, '{c}' AS class, {y} AS y, (40 * {y} + (doc_id * {13 + 4 * k}) % 61) / 100.0::DOUBLE AS prob, CAST(40 * {y} + (doc_id * {13 + 4 * k}) % 61 >= 50 AS INT) AS pred FROM labels" for k, (c, y) in enumerate(zip(CLASSES, Y))
) + "), cm AS (SELECT class, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM long GROUP BY 1)"


def items(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    points = [f"cast(40 * {y} + (doc_id * {13 + 4 * k}) % 61 as int)" for k, y in enumerate(Y)]
    y, x = ", ".join(f"cast({v} as int)" for v in Y), ", ".join(points)
    return d.selectExpr("doc_id id", f"array({y}) y", f"transform(array({x}), x -> x / 100.0D) prob", f"transform(array({x}), x -> cast(x >= 50 as int)) pred")


def long_rows(spark, sf_dir):
    return E.long_form(items(spark, sf_dir), "y", "pred", "prob")


METRICS = """class, tp, fp, fn, tn, tp + fn AS support, round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 4) AS prevalence, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision,
  round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall, round(tn / nullif(fp + tn, 0)::DOUBLE, 4) AS specificity,
  round(CASE WHEN tp + fn > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END, 4) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS binary_accuracy,
  round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(fp + tn, 0)::DOUBLE) / 2, 4) AS balanced_accuracy, round(fp / nullif(fp + tn, 0)::DOUBLE, 4) AS fpr,
  round(fn / nullif(tp + fn, 0)::DOUBLE, 4) AS fnr, tp + fn > 0 AND fp + tn > 0 AS is_valid"""


@query(LONG + f" SELECT {METRICS} FROM cm")
def per_class_metrics(spark, sf_dir):
    return E.class_metrics(long_rows(spark, sf_dir))


@query(LONG + f""", z AS (SELECT id, 'not_relevant' AS class, 1 - max(y) AS y, 1 - max(pred) AS pred FROM long GROUP BY 1),
c0 AS (SELECT class, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM z GROUP BY 1)
SELECT {METRICS} FROM c0""")
def class0_metrics(spark, sf_dir):
    return E.class_zero_metrics(long_rows(spark, sf_dir))


@query(LONG + """, f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f, tp + fn AS s FROM cm),
i AS (SELECT id, CAST(max(abs(y - pred)) = 0 AS DOUBLE) AS same, sum(y) AS n FROM long GROUP BY 1)
SELECT round(avg(f), 4) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 4) AS micro_f1, round(sum(f * s) / sum(s), 4) AS weighted_f1, round(avg(p), 4) AS macro_precision,
  round(avg(r), 4) AS macro_recall, round(sum(tp) / sum(tp + fp)::DOUBLE, 4) AS micro_precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 4) AS micro_recall,
  round(sum(fp + fn) / sum(tp + fp + fn + tn)::DOUBLE, 4) AS hamming_loss, (SELECT round(avg(same), 4) FROM i) AS subset_accuracy, (SELECT round(avg(n), 4) FROM i) AS cardinality,
  (SELECT round(avg(n / 5.0::DOUBLE), 4) FROM i) AS density FROM f""")
def global_multilabel_metrics(spark, sf_dir):
    return E.global_metrics(long_rows(spark, sf_dir))


STEPS = LONG + """, d AS (SELECT class, prob, sum(y) AS p, sum(1 - y) AS m FROM long GROUP BY ALL),
w AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY prob DESC) AS tp, sum(m) OVER (PARTITION BY class ORDER BY prob DESC) AS fp, sum(p) OVER (PARTITION BY class) AS pos FROM d)
"""


@query(STEPS + "SELECT class, round(sum(p * tp / (tp + fp)::DOUBLE) / max(pos), 4) AS average_precision FROM w GROUP BY 1")
def average_precision(spark, sf_dir):
    return E.average_precision(long_rows(spark, sf_dir))


@query(LONG + "SELECT a.class, round(sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 4) AS roc_auc FROM long a JOIN long b ON a.class = b.class AND a.y = 1 AND b.y = 0 GROUP BY 1")
def roc_auc(spark, sf_dir):
    return E.roc_auc(long_rows(spark, sf_dir))


@query(STEPS + """SELECT class, prob AS threshold, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / pos::DOUBLE, 4) AS recall FROM w WHERE pos > 0
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0::DOUBLE, 0::DOUBLE FROM w WHERE pos = 0""")
def pr_curve(spark, sf_dir):
    return E.pr_curve(long_rows(spark, sf_dir))


@query(LONG + """, t AS (SELECT (10 + 2 * i) / 100.0::DOUBLE AS t FROM range(41) x(i)),
c AS (SELECT class, t, count(*) FILTER (y = 1 AND prob >= t) AS tp, count(*) FILTER (y = 0 AND prob >= t) AS fp, count(*) FILTER (y = 1 AND prob < t) AS fn FROM long, t GROUP BY ALL),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, row_number() OVER (PARTITION BY class ORDER BY coalesce(2 * p * r / nullif(p + r, 0), 0) DESC, t) AS n FROM q)
SELECT class, round(t, 4) AS threshold, round(f, 4) AS f1 FROM f WHERE n = 1""")
def optimize_class_thresholds(spark, sf_dir):
    return E.class_thresholds(long_rows(spark, sf_dir))


@query(LONG + """, k AS (SELECT class, sum(y) AS s FROM long WHERE toxic_set GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM long WHERE toxic_set)
SELECT 'low_support' AS "check", class FROM k WHERE s BETWEEN 1 AND 4 UNION ALL SELECT 'no_support', class FROM k WHERE s = 0
UNION ALL SELECT 'few_items', 'all' FROM n WHERE n < 30""".replace("toxic_set", "id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1)"))
def consistency_checks(spark, sf_dir):
    """Checks of a small evaluation set: the bad and toxic documents."""
    few = table(spark, sf_dir, "labels").filter("quality = 0 and toxic = 1").select(F.col("doc_id").alias("id"))
    return E.consistency_checks(long_rows(spark, sf_dir).join(few, "id", "left_semi"))


@query(STEPS + """, ap AS (SELECT class, round(sum(p * tp / (tp + fp)::DOUBLE) / max(pos), 4) AS average_precision FROM w GROUP BY 1),
au AS (SELECT a.class, round(sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 4) AS roc_auc FROM long a JOIN long b ON a.class = b.class AND a.y = 1 AND b.y = 0 GROUP BY 1)
SELECT class, tp + fn AS support, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision, average_precision, roc_auc FROM cm JOIN ap USING (class) JOIN au USING (class)""")
def evaluation_table(spark, sf_dir):
    return E.class_table(long_rows(spark, sf_dir)).select("class", "support", "precision", "average_precision", "roc_auc")


def _model_sql(name: str, vectors: str) -> str:
    """Calibration and ranking of one model's vectors, as the two queries above state them."""
    of = lambda sql: sql.replace("FROM embeddings", f"FROM (SELECT vec_id, {vectors} AS embedding, label FROM embeddings)")
    return f"SELECT c.*, m.ndcg, '{name}' AS model FROM ({of(ORACLE_SQL['calibrate_threshold'])}) c, ({of(ORACLE_SQL['ir_ranking_metrics'])}) m"


@query(_model_sql("full", "embedding") + " UNION ALL " + _model_sql("half", "embedding[1:32]"))
def model_comparison(spark, sf_dir):
    """Two models' vectors (the given ones and their first half) on the same gold standard."""
    from ..operators import search
    from .search_plans import anchors, paragraphs

    half = lambda d: d.withColumn("embedding", F.slice("embedding", 1, 32))
    both = {"full": (paragraphs(spark, sf_dir), anchors(spark, sf_dir)), "half": (half(paragraphs(spark, sf_dir)), half(anchors(spark, sf_dir)))}
    found = {}
    for name, (p, a) in both.items():
        r = search.multi_anchor_search(p, a, threshold=0.0)
        found[name] = r.select("paragraph_id", unit_score(), "rank")
    return E.compare_models(found, gold(spark, sf_dir))


REPLICATES = 200
_WRAP = "CAST(({0}::UHUGEINT * {1}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
_CI = ["SELECT 'macro_f1' AS metric, 'all' AS class, r, " + "(" + " + ".join(f"coalesce(2 * tp{i} / nullif(2 * tp{i} + fp{i} + fn{i}, 0)::DOUBLE, 0)" for i in range(5)) + ") / 5 AS v FROM c"]
_SUM = lambda c: "(" + " + ".join(f"{c}{i}" for i in range(5)) + ")"
_CI += [f"SELECT 'micro_f1', 'all', r, coalesce(2 * {_SUM('tp')} / nullif(2 * {_SUM('tp')} + {_SUM('fp')} + {_SUM('fn')}, 0)::DOUBLE, 0) FROM c", "SELECT 'exact_match', 'all', r, same / n::DOUBLE FROM c", f"SELECT 'hamming_loss', 'all', r, ({_SUM('fp')} + {_SUM('fn')}) / (5 * n)::DOUBLE FROM c"]
for _i, _c in enumerate(CLASSES):
    _CI += [f"SELECT 'precision', '{_c}', r, tp{_i} / nullif(tp{_i} + fp{_i}, 0)::DOUBLE FROM c", f"SELECT 'recall', '{_c}', r, tp{_i} / nullif(tp{_i} + fn{_i}, 0)::DOUBLE FROM c", f"SELECT 'f1', '{_c}', r, 2 * tp{_i} / nullif(2 * tp{_i} + fp{_i} + fn{_i}, 0)::DOUBLE FROM c"]
_PLACE = [f"max(y) FILTER (class = '{c}') AS y{i}, max(pred) FILTER (class = '{c}') AS p{i}" for i, c in enumerate(CLASSES)]
_COUNTS = ", ".join(f"coalesce(sum(w) FILTER (y{i} = 1 AND p{i} = 1), 0)::DOUBLE AS tp{i}, coalesce(sum(w) FILTER (y{i} = 0 AND p{i} = 1), 0)::DOUBLE AS fp{i}, coalesce(sum(w) FILTER (y{i} = 1 AND p{i} = 0), 0)::DOUBLE AS fn{i}" for i in range(5))


@query(LONG + f""", wide AS (SELECT id, {", ".join(_PLACE)} FROM long GROUP BY id),
x0 AS (SELECT wide.*, r, CAST((id::UHUGEINT + {_WRAP.format("(r + 42)", E.REPLICATE)}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM wide, range({REPLICATES}) t(r)),
x1 AS (SELECT *, {_WRAP.format("xor(x, x >> 30)", E.MIX[0])} AS a FROM x0), x2 AS (SELECT *, {_WRAP.format("xor(a, a >> 27)", E.MIX[1])} AS b FROM x1),
x3 AS (SELECT *, xor(b, b >> 31) >> 32 AS u FROM x2),
x4 AS (SELECT *, {" + ".join(f"CAST(u >= {t} AS BIGINT)" for t in E.POISSON)} AS w FROM x3),
c AS (SELECT r, sum(w) AS n, sum(w) FILTER ({" AND ".join(f"y{i} = p{i}" for i in range(5))}) AS same, {_COUNTS} FROM x4 GROUP BY r HAVING sum(w) > 0),
v AS ({" UNION ALL ".join(_CI)})
SELECT metric, class, count(v) AS valid, CASE WHEN count(v) >= 50 THEN round(quantile_cont(v, 0.025), 4) END AS lower, CASE WHEN count(v) >= 50 THEN round(quantile_cont(v, 0.975), 4) END AS upper FROM v GROUP BY ALL""")
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap(long_rows(spark, sf_dir), REPLICATES)
