"""Structured extraction: parsing, aliases, literal evidence, caching, throttling and statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key

# The extraction's fields and the older names of some, first found first used.
FIELDS = ("concepts", "definitions", "determinants", "dimensions", "causal_relations", "properties", "mechanisms", "consequences", "evidence")
ALIASES = {
    "concepts": ("main_concept", "normalized_concept"),
    "dimensions": ("vulnerability_dimensions", "types_dimensions"),
    "determinants": ("factors", "driver_factors"),
    "causal_relations": ("causes", "relations"),
}
REFINING = ("concepts", "definitions", "determinants", "dimensions", "causal_relations", "properties")


def _array(raw: Column, name: str) -> Column:
    """A field as an array of strings: a scalar becomes one element; null where the key is absent or null."""
    v = F.get_json_object(raw, f"$.{name}")
    listed = F.from_json(v, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(v.startswith("["), listed).when(v.isNotNull() & (v != ""), F.array(v))


def _has_key(raw: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(raw), name), F.lit(False))


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with json_valid, the nine arrays and confidence; an alias counts only where the canonical key is absent."""
    r = F.col(raw)
    ok = F.coalesce(F.is_valid_utf8(F.encode(r, "UTF-8")) & F.try_parse_json(r).isNotNull(), F.lit(False)) & F.coalesce(F.ltrim(r).startswith("{"), F.lit(False))
    out = df.withColumn("json_valid", ok).withColumn("_j", F.when(ok, r))
    j, empty = F.col("_j"), F.array().cast("array<string>")
    cols = []
    for f in FIELDS:
        value = _array(j, f)
        for alias in reversed(ALIASES.get(f, ())):
            # an empty first alias of the concepts lets the next one count; elsewhere the first present one does
            there = _has_key(j, alias) & (_array(j, alias).isNotNull() if f == "concepts" else F.lit(True))
            value = F.when(~_has_key(j, f) & there, _array(j, alias)).otherwise(value)
        cols.append(F.coalesce(value, empty).alias(f))
    conf = F.coalesce(F.try_to_number(F.get_json_object(j, "$.confidence"), F.lit("9.99999")).cast("double"), F.lit(1.0))
    return out.select(*df.columns, "json_valid", *cols, conf.alias("confidence")).withColumn("schema_valid", F.col("json_valid") & F.col("confidence").between(0, 1))


def _plain(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), "(?U)\\s+", " "))


def snippets(evidence) -> Column:
    return F.filter(evidence, lambda e: e.isNotNull() & (F.trim(e) != ""))


def valid_snippets(text, evidence) -> Column:
    return F.filter(snippets(evidence), lambda e: F.contains(_plain(text), _plain(e)))


def evidence_valid(text, evidence) -> Column:
    """Every non-blank snippet occurs literally in the text, case and white space aside; none at all is valid."""
    return F.coalesce(F.size(valid_snippets(text, evidence)) == F.size(snippets(evidence)), F.lit(True))


def refined(df: DataFrame, require_evidence: bool = True) -> DataFrame:
    some = sum((F.size(c) for c in REFINING), F.lit(0)) > 0
    return df.filter(F.col("schema_valid") & some & (F.col("evidence_valid") | F.lit(not require_evidence)))


def statistics(df: DataFrame) -> DataFrame:
    """Share of valid JSON and schemas, of valid snippets (evr), and of paragraphs whose evidence exists and holds (pvr)."""
    s = df.select("json_valid", "schema_valid", F.size(snippets(F.col("evidence"))).alias("n"), F.size(valid_snippets(F.col("text"), F.col("evidence"))).alias("ok"))
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 2)
    n = F.count("*")
    return s.agg(
        n.alias("n"), pct(F.count_if("json_valid"), n).alias("json_valid_pct"), pct(F.count_if("schema_valid"), n).alias("schema_valid_pct"),
        pct(F.sum("ok"), F.sum("n")).alias("evr"), pct(F.count_if((F.col("n") > 0) & (F.col("ok") == F.col("n"))), n).alias("pvr"),
    )


def keyed(df: DataFrame, model: str, prompt: str, options: str) -> DataFrame:
    return df.withColumn("cache_key", cache_key("text", F.lit(model), F.lit(prompt), F.lit(options)))


def misses(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows without a successful cached result."""
    return df.join(cache.filter("schema_valid").select("cache_key").distinct(), "cache_key", "left_anti")


def min_interval(rpm: float | None) -> float:
    return 60.0 / rpm if rpm and rpm > 0 else 0.0


def remaining_seconds(rpm: float | None, n: int) -> float:
    return n / rpm * 60.0 if rpm and rpm > 0 else 0.0


def mock_provider(text: str) -> str:
    """A fixed answer whose evidence is the text's first five words."""
    import json

    words = text.split()
    return json.dumps({"concepts": ["concept"], "definitions": ["definition"], "evidence": [" ".join(words[:5]) if words else text], "confidence": 0.95})


def mock_answers(df: DataFrame) -> DataFrame:
    """The mock provider in expressions."""
    words = F.slice(F.filter(F.split("text", "(?U)\\s+"), lambda x: x != ""), 1, 5)
    return df.withColumn("raw", F.to_json(F.struct(F.array(F.lit("concept")).alias("concepts"), F.array(F.lit("definition")).alias("definitions"), F.array(F.array_join(words, " ")).alias("evidence"), F.lit(0.95).alias("confidence"))))


def _ask(todo: DataFrame, provider: Callable[[str], str], rpm: float | None, workers: int) -> DataFrame:
    """todo with the provider's answer in raw; rows that have a raw answer keep it.  A rate limit is dealt over the workers,
    each asking at its share of the pace."""
    if "raw" not in todo.columns:
        todo = todo.withColumn("raw", F.lit(None).cast("string"))
    todo = todo.repartition(workers) if rpm else todo
    pause = min_interval(rpm)

    def run(batches):
        from pyspark import TaskContext

        following = time.monotonic() + pause * (TaskContext.get().partitionId() % workers)
        for b in batches:
            raws = []
            for text, have in zip(b["text"], b["raw"]):
                if have is not None:
                    raws.append(have)
                    continue
                if pause:
                    time.sleep(max(0.0, following - time.monotonic()))
                    following = max(following, time.monotonic()) + pause * workers
                try:
                    raws.append(provider(text or ""))
                except Exception:  # a provider's failure is this row's result
                    raws.append(None)
            yield b.assign(raw=pd.Series(raws, index=b.index, dtype=object))

    return todo.mapInPandas(run, todo.schema)


def _checked(answered: DataFrame) -> DataFrame:
    return parse(answered).withColumn("evidence_valid", evidence_valid(F.col("text"), F.col("evidence")))


def _with_cached(df: DataFrame, cache: DataFrame) -> DataFrame:
    """df with the raw answer of a successful cached result, null without one: one join."""
    known = cache.filter("schema_valid").groupBy("cache_key").agg(F.min("raw").alias("raw"))
    return df.drop("raw").join(known, "cache_key", "left").select(*(c for c in df.columns if c != "raw"), "raw")


def extract(df: DataFrame, provider: Callable[[str], str] = mock_provider, rpm: float | None = None, cache: DataFrame | None = None, workers: int = 4) -> DataFrame:
    """One row for each of df: a cached answer where there is a successful one, else the provider's.  With a rate limit
    so many workers share its pace.  A failed request leaves a null answer, which does not count as cached."""
    return _checked(_ask(df if cache is None else _with_cached(df, cache), provider, rpm, workers))


def extract_to(df: DataFrame, path: str, provider: Callable[[str], str] = mock_provider, rpm: float | None = None, steps: int = 10, workers: int = 4) -> DataFrame:
    """extract() of df (with cache_key) by steps, each added to the table at path when it is done: a call that was cut
    short goes on after its last whole step.  Equal keys are asked once.  Returns df's rows with their answers.

    What is to be asked is found by one pass over df and one join with the answers so far, and written once, by step."""
    from ..sources.readers import path_exists

    spark = df.sparkSession
    answers, todo = f"{path}/answers", f"{path}/todo"
    keys = df.groupBy("cache_key").agg(F.min("text").alias("text"))
    if path_exists(spark, answers):
        keys = misses(keys, spark.read.parquet(answers)).select("cache_key", "text")
    keys.withColumn("step", F.pmod(F.xxhash64("cache_key"), F.lit(steps)).cast("int")).write.mode("overwrite").partitionBy("step").parquet(todo)
    asked = spark.read.schema("cache_key string, text string, step int").parquet(todo)
    for step in range(steps):
        part = asked.filter(F.col("step") == step).drop("step")
        if not part.isEmpty():
            _checked(_ask(part, provider, rpm, workers)).write.mode("append").parquet(answers)
    if not path_exists(spark, answers):
        _checked(_ask(keys.limit(0), provider, None, workers)).write.parquet(answers)
    return extract_cached(df, spark.read.parquet(answers))


def run_statistics(results: DataFrame, run_id: str, model: str, rpm: float | None = None, seconds: float = 0.0) -> dict:
    """A run's figures for its statistics file; an empty run has none.  Rates are per cent, rounded to two places."""
    good, all_of = F.size(valid_snippets(F.col("text"), F.col("evidence"))), F.size(snippets(F.col("evidence")))
    r = results.agg(
        F.count("*").alias("n"), F.count_if("json_valid").alias("json"), F.count_if("schema_valid").alias("schema"), F.coalesce(F.sum(all_of), F.lit(0)).alias("shown"),
        F.coalesce(F.sum(good), F.lit(0)).alias("good"), F.count_if((all_of > 0) & (all_of == good)).alias("paragraphs"),
    ).first()
    if not r.n:
        return {}
    pct = lambda a, b: round(100.0 * a / b, 2) if b else 0.0
    return {
        "run_id": run_id, "llm_model": model, "processed_paragraphs": r.n, "json_valid_count": r.json, "json_valid_pct": pct(r.json, r.n), "schema_valid_count": r.schema,
        "schema_valid_pct": pct(r.schema, r.n), "total_evidences_evaluated": r.shown, "valid_evidences_count": r.good, "evidence_validation_rate_evr": pct(r.good, r.shown),
        "paragraphs_with_valid_evidence": r.paragraphs, "paragraph_validation_rate_pvr": pct(r.paragraphs, r.n), "total_processing_time_sec": round(seconds, 2),
        "total_wait_time_sec": round(min_interval(rpm) * max(0, r.n - 1), 2), "rpm_configured": rpm,
    }


def save_statistics(results: DataFrame, path: str, run_id: str, model: str, rpm: float | None = None, seconds: float = 0.0) -> dict:
    """Write run_statistics() as JSON at path and return them; nothing is written of an empty run."""
    from ..sources.writers import save_manifest

    stats = run_statistics(results, run_id, model, rpm, seconds)
    if stats:
        save_manifest(results.sparkSession, path, stats)
    return stats


def extract_cached(df: DataFrame, cache: DataFrame) -> DataFrame:
    """df with cached answers only; null where the last attempt failed."""
    return _checked(_with_cached(df, cache))
