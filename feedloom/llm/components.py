"""Connected components of a link table, by alternating stars: no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return (both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    joined = edges.join(least, "src")
    moved = joined.filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionAll(least.select("src", F.col("low").alias("dst"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (two long columns): the smallest id reachable.

    Links with a null end are left out. Each round is written to the shared folder; a root with very
    many members is one row on the aggregated side of each join, so adaptive skew joins can split it.
    """
    a, b = links.columns[:2]
    edges = (links.filter(f"`{a}` <> `{b}`")
             .select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct())
    seen = None
    while True:
        state = Observation()
        edges = stored(_small_star(_large_star(edges)).observe(
            state, F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum")), "edges")
        if state.get == seen:
            break
        seen = state.get
    roots = edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionAll(roots)
