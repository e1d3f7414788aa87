"""Importing this module registers every query."""

from feedloom.plans import (  # noqa: F401
    classify_queries,
    compare_queries,
    feature_queries,
    insight_queries,
    quality_queries,
    storage_queries,
    text_queries,
)
from feedloom.plans.registry import REGISTRY, runner

__all__ = ["REGISTRY", "runner"]
