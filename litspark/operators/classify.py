"""One-vs-rest logistic regression, per-class thresholds and the classified corpus."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import CLASSES


class OneVsRest:
    """A balanced, L2-penalised logistic model per class.  A class with one kind of label predicts that constant."""

    def __init__(self, c: float = 1.0, max_iter: int = 100, classes=CLASSES):
        self.c, self.max_iter, self.classes = c, max_iter, tuple(classes)
        self.models: dict[str, LogisticRegressionModel | float] = {}
        self.thresholds = dict.fromkeys(self.classes, 0.5)

    def fit(self, train: DataFrame, features: str = "embedding", y: str = "y") -> OneVsRest:
        """train: a vector array and an array of 0/1 labels, one per class."""
        rows = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(y).alias("y")).cache()
        sums = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("y")[i]).alias(f"p{i}") for i in range(len(self.classes)))).first()
        if not sums.n:
            raise ValueError("no training rows")
        for i, name in enumerate(self.classes):
            pos = sums[f"p{i}"]
            if pos in (0, sums.n):
                self.models[name] = float(pos > 0)
                continue
            label = F.col("y")[i].cast("double")
            weight = F.when(label == 1, sums.n / (2.0 * pos)).otherwise(sums.n / (2.0 * (sums.n - pos)))
            lr = LogisticRegression(regParam=1.0 / (self.c * sums.n), elasticNetParam=0.0, standardization=False, maxIter=self.max_iter, weightCol="w")
            self.models[name] = lr.fit(rows.select("features", label.alias("label"), weight.alias("w")))
        rows.unpersist()
        return self

    def predict_proba(self, df: DataFrame, features: str = "embedding") -> DataFrame:
        """df with probabilities (map<string,double>), in expressions of each model's coefficients."""
        if not self.models:
            raise RuntimeError("the model is not fitted")
        v = F.col(features).cast("array<double>")

        def prob(name) -> Column:
            m = self.models[name]
            if isinstance(m, float):
                return F.lit(m)
            w = F.array(*(F.lit(float(x)) for x in m.coefficients))
            z = F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(float(m.intercept)), lambda s, x: s + x)
            return 1.0 / (1.0 + F.exp(-z))

        return df.withColumn("probabilities", F.create_map(*(x for c in self.classes for x in (F.lit(c), F.round(prob(c), 6)))))

    def transform(self, df: DataFrame, features: str = "embedding") -> DataFrame:
        return apply_thresholds(self.predict_proba(df, features), self.thresholds)

    def set_thresholds(self, rows: DataFrame) -> OneVsRest:
        """rows (class, threshold), as class_thresholds gives."""
        self.thresholds |= {r["class"]: r["threshold"] for r in rows.collect()}  # one row a class
        return self

    def save(self, path: str) -> None:
        """Models, constants and thresholds under one folder."""
        import json

        for name, m in self.models.items():
            if not isinstance(m, float):
                m.write().overwrite().save(f"{path}/{name}")
        meta = {"classes": self.classes, "c": self.c, "thresholds": self.thresholds, "constants": {n: m for n, m in self.models.items() if isinstance(m, float)}}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> OneVsRest:
        import json

        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        out = cls(meta["c"], classes=meta["classes"])
        out.thresholds = meta["thresholds"]
        out.models = {n: meta["constants"][n] if n in meta["constants"] else LogisticRegressionModel.load(f"{path}/{n}") for n in out.classes}
        return out


def vector_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1])


def apply_thresholds(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """df (probabilities) with predicted_labels and status MODEL_RELEVANT or MODEL_NOT_RELEVANT."""
    hits = F.array(*(F.when(F.coalesce(F.col("probabilities")[c], F.lit(0.0)) >= t, F.lit(c)) for c, t in thresholds.items()))
    out = df.withColumn("predicted_labels", F.filter(hits, lambda x: x.isNotNull()))
    return out.withColumn("status", F.when(F.size("predicted_labels") > 0, "MODEL_RELEVANT").otherwise("MODEL_NOT_RELEVANT"))


def sync(corpus: DataFrame, classified: DataFrame, reset_to: str = "RAW") -> DataFrame:
    """The corpus with the batch's states and labels; rows that are not in the batch are reset."""
    c = classified.select("paragraph_id", F.col("status").alias("_s"), F.col("predicted_labels").alias("_l"), F.col("probabilities").alias("_p"))
    out = corpus.drop("status", "predicted_labels", "probabilities").join(c, "paragraph_id", "left")
    return out.select(
        *[x for x in out.columns if x not in ("_s", "_l", "_p")], F.coalesce("_s", F.lit(reset_to)).alias("status"),
        F.coalesce("_l", F.array().cast("array<string>")).alias("predicted_labels"), F.coalesce("_p", F.create_map().cast("map<string,double>")).alias("probabilities"),
    )


def class_statistics(df: DataFrame) -> DataFrame:
    """Per class: labelled paragraphs and documents, their share, and the probability's figures over all rows."""
    p = df.select("article_id", "paragraph_id", "predicted_labels", F.explode("probabilities").alias("class", "p"))
    on = F.array_contains("predicted_labels", F.col("class"))
    out = p.groupBy("class").agg(
        F.count_if(on).alias("n_paragraphs"), F.count_distinct(F.when(on, F.col("article_id"))).alias("n_documents"), F.round(100.0 * F.count_if(on) / F.count("*"), 2).alias("pct"),
        F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.median("p"), 4).alias("median_p"), F.round(F.max("p"), 4).alias("max_p"),
    )
    return out


def document_coverage(df: DataFrame) -> DataFrame:
    """Documents with and without relevant paragraphs, and relevant paragraphs per relevant document: one row."""
    per = df.groupBy("article_id").agg(F.count_if(F.col("status") == "MODEL_RELEVANT").alias("n"))
    rel = F.when(F.col("n") > 0, F.col("n"))
    z = lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 4)
    return per.agg(F.count(rel).alias("relevant_docs"), F.count_if(F.col("n") == 0).alias("not_relevant_docs"), z(F.avg(rel)).alias("mean_paragraphs"), z(F.median(rel)).alias("median_paragraphs"))


def p_max(df: DataFrame) -> DataFrame:
    """Greatest probability of each document's paragraphs."""
    m = F.coalesce(F.array_max(F.map_values("probabilities")), F.lit(0.0))
    return df.groupBy("article_id").agg(F.round(F.max(m), 4).alias("p_max"), F.count("*").alias("n"))


def class_cooccurrence(df: DataFrame) -> DataFrame:
    """Paragraphs that hold both labels of each pair, a <= b."""
    l = F.array_sort("predicted_labels")  # noqa: E741
    pairs = F.flatten(F.transform(l, lambda x: F.transform(F.filter(l, lambda y: y >= x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def documents_without(df: DataFrame) -> DataFrame:
    """Documents none of whose paragraphs is relevant."""
    return df.select("article_id").distinct().join(df.filter("status = 'MODEL_RELEVANT'").select("article_id").distinct(), "article_id", "left_anti")

