"""Time slices, and checks that growing in steps gives what growing at once would."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_slice(df: DataFrame, at: str, *, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows with since < at <= until. Slices that share a border neither overlap nor leave a gap."""
    if since is not None:
        df = df.where(F.col(at) > F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        df = df.where(F.col(at) <= F.lit(until).cast("timestamp_ntz"))
    return df


def slice_equivalence(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows only in the first, rows only in the second, counting repeats (0 and 0 when equal).

    Both sides are counted per distinct row in one aggregate instead of two set differences.
    """
    both = first.withColumn("__side", F.lit(1)).unionByName(second.withColumn("__side", F.lit(-1)))
    balance = both.groupBy(*first.columns).agg(F.sum("__side").alias("more"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.greatest(-F.col("more"), F.lit(0))), F.lit(0)).alias("only_second"))


def missing_keys(source: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is not stored yet: what a repeated run still has to do."""
    return source.join(existing.select(key), key, "left_anti")


def late_reviews(reviews: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Reviews that came in a later batch than the purchase they review."""
    lines = order_lines.select("order_line_id", F.col("batch_id").alias("line_batch")).distinct()
    return reviews.select("review_id", "order_line_id", F.col("batch_id").alias("review_batch")) \
        .join(lines, "order_line_id").where("line_batch < review_batch")


def dry_run_report(tables: dict[str, DataFrame], estimate: DataFrame) -> DataFrame:
    """(table, rows) of a batch that would be written, and its estimate as (name, value). Writes nothing."""
    counts = [df.agg(F.lit(name).alias("item"), F.count(F.lit(1)).cast("double").alias("value"))
              for name, df in tables.items()]
    named = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in estimate.columns])
    report = estimate.select(F.inline(named))
    for c in counts:
        report = report.unionByName(c)
    return report
