"""The entry module with and without the training-data operators."""

import importlib
import subprocess
import sys

import __spark_entry__ as entry
from litspark.plans import catalogue

from .conftest import ROOT


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["article_id", "paragraph_id", "aggregate_score", "best_anchor_id", "selected", "rank"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


def test_library_stands_alone():
    """Nothing but the entry module knows the training-data operators, and it does without them."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("litspark.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_no_stray_imports():
    import pathlib

    for p in pathlib.Path(ROOT, "litspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "litspark.llm" not in p.read_text() and ".llm" not in p.read_text(), p
    assert importlib.import_module("litspark.plans.catalogue").QUERIES
