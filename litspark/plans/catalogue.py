"""All registered queries of the library with their SQL."""

from . import annotation_plans, corpus_plans, evaluation_plans, model_plans, search_plans, store_plans, text_plans  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
