"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans.domain import Domain


@dataclass(frozen=True)
class Query:
    run: Callable[[Domain], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register `build(domain) -> DataFrame` under `name`."""
    def add(build: Callable[[Domain], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build
    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: REGISTRY[name].run(Domain(spark, sf_dir))
