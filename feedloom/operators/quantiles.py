"""Exact quantiles of a column too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CUTS = 256  # parts a range is cut into at a time
RANKED = 100_000  # distinct values that are ranked in one task; a matter of speed only


def _at_rank(values: DataFrame, rank: int) -> object:
    """The value at a rank (from 0) of the column v, by narrowing the range around it. Runs jobs."""
    while True:
        seen = values.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("kinds"),
                          F.percentile_approx("v", [k / CUTS for k in range(CUTS + 1)], 10_000).alias("cuts")).first()
        cuts = sorted(set(seen["cuts"]))
        if seen["kinds"] <= RANKED or len(cuts) == 1:
            run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ranked = values.groupBy("v").agg(F.count(F.lit(1)).alias("times")).select(
                "v", F.sum("times").over(run).alias("upto"))
            return ranked.where(F.col("upto") > rank).agg(F.min("v")).first()[0]
        # exact counts per part decide, so a poor sketch costs another round but never a wrong value
        edges = F.array(*[F.lit(c) for c in cuts])
        part = F.size(F.filter(edges, lambda c: c <= F.col("v")))
        below = 0
        for row in values.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
            if below + row["n"] > rank:
                break
            below += row["n"]
        values = values.where(part == row["part"])
        rank -= below


def exact_quantile(df: DataFrame, column: str, q: float = 0.5) -> DataFrame:
    """One row `(value)`: the linearly interpolated quantile, the same as sorting the whole column; null without values.

    Runs jobs: the range around the rank is cut by a mergeable sketch and counted, again and again until few
    distinct values are left. Pass a stored table.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
    at = (n - 1) * q
    low = _at_rank(values, int(at))
    high = _at_rank(values, int(at) + 1) if at > int(at) else low
    return df.sparkSession.range(1).select(F.lit(float(low + (high - low) * (at - int(at)))).alias("value"))


def quantiles_of_counts(df: DataFrame, by: Sequence[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Per `by`, exact quantiles of a column with few distinct values (counts, milliseconds).

    Equal values are counted before the shuffle, so a group arrives as one row per distinct value.
    """
    histogram = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("times"))
    return histogram.groupBy(*by).agg(
        *[F.percentile(column, q, F.col("times")).alias(name) for name, q in wanted.items()])
