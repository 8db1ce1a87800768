"""A project folder: its metadata, stage tables and snapshots, through Spark's file systems."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import path_exists, table_or_none
from ..sources.writers import load_manifest, save_manifest, save_stage

STAGES = ("articles", "segments", "vectors", "search", "annotations", "classification", "index", "extraction")
LEGACY = ("corpus.jsonl", "paragraphs/corpus.jsonl", "manifests/ingestion_manifest.jsonl", "run_config.json")


# The folders of a run and the settings that an analysis starts with.
FOLDERS = ("config", "markdown", "metadata", "paragraphs", "interim", "embeddings", "semantic_search", "annotations", "models", "classifications", "corpus_final", "llm", "reports", "logs")
DEFAULTS = {
    "batch_size": 32, "min_words": 8, "min_characters": 40, "max_characters": 500, "long_text_strategy": "chunk", "chunk_overlap": 100, "chunk_aggregation": "maximum",
    "ref_confidence_threshold": 0.60, "top_k": 20, "similarity_threshold": 0.50, "aggregation_strategy": "maximum", "minimum_recall_target": 0.90, "random_seed": 42, "semantic_batch_size": 8192,
}


def run_id(now: datetime | None = None) -> str:
    return f"run_{now or datetime.now():%Y_%m_%d_%H%M%S}"


def run_folders(spark: SparkSession, base: str, run: str) -> dict[str, str]:
    """Make and name a run's folders."""
    out = {"root": f"{base.rstrip('/')}/{run}"} | {f: f"{base.rstrip('/')}/{run}/{f}" for f in FOLDERS} | {"processed": f"{base.rstrip('/')}/{run}/paragraphs"}
    for path in out.values():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return out


def default_config(**changed) -> dict:
    """The settings with some of them changed; unknown names are an error."""
    if unknown := set(changed) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return DEFAULTS | changed


class Project:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.root}/analysis")

    def is_legacy(self) -> bool:
        """Files of an older layout without the metadata of this one."""
        return not self.exists() and any(path_exists(self.spark, f"{self.root}/{f}") for f in LEGACY)

    def create(self, config: dict | None = None, status: str = "new") -> dict:
        now = datetime.now(timezone.utc).isoformat()
        meta = {"analysis_id": f"analysis_{now[:19]}", "created_at": now, "updated_at": now, "status": status, "config": config or {}}
        save_manifest(self.spark, f"{self.root}/analysis", meta)
        return meta

    def migrate(self, config: dict | None = None) -> dict:
        if not self.is_legacy():
            raise ValueError("no older project here")
        return self.create(config, "migrated")

    def metadata(self) -> dict:
        return load_manifest(self.spark, f"{self.root}/analysis") if self.exists() else self.create()

    def set_status(self, status: str, **config) -> dict:
        meta = self.metadata()
        meta |= {"status": status, "updated_at": datetime.now(timezone.utc).isoformat(), "config": meta["config"] | config}
        save_manifest(self.spark, f"{self.root}/analysis", meta)
        return meta

    def write_stage(self, stage: str, df: DataFrame, config: dict | None = None) -> None:
        save_stage(df, self.root, stage, config)

    def read_stage(self, stage: str) -> DataFrame | None:
        return table_or_none(self.spark, f"{self.root}/{stage}/data")

    def stages(self) -> list[tuple[str, bool]]:
        return [(s, path_exists(self.spark, f"{self.root}/{s}/data")) for s in STAGES]

    def restore(self) -> dict[str, DataFrame]:
        """Every stage that is there."""
        return {s: self.read_stage(s) for s, there in self.stages() if there}

    def snapshot(self, state: dict) -> None:
        save_manifest(self.spark, f"{self.root}/session", state)

    def load_snapshot(self) -> dict:
        return load_manifest(self.spark, f"{self.root}/session") if path_exists(self.spark, f"{self.root}/session") else {}
