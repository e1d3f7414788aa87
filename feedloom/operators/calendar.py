"""Moments beside a calendar table whose entries reach over an interval of days.

An interval join compares every moment with every entry unless it is cut: here entries are laid into bins of days, those
of one bin gathered into one row, and a moment meets the single row of its bin by an equal key. So the table of moments
keeps its rows, nothing is regrouped, and there is no nested loop. What a bin holds is bounded by the entries that reach
into it, never by the moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_DAYS = 16
REACH = 8.0  # widths: beyond, a bell curve is below 1e-13
DAY_SECONDS = 86_400
CALENDAR_DDL = "held_at TIMESTAMP_NTZ, boost DOUBLE, width DOUBLE"


def _day(at: Column) -> Column:
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))


def with_boost(moments: DataFrame, at: str, calendar: DataFrame, *, name: str = "boost", bin_days: int = BIN_DAYS) -> DataFrame:
    """`moments` with the sum of what all calendar entries near `at` add: boost * exp(-(days away / width)^2 / 2).

    Entries without a time, boost or positive width count for nothing; repeated entries count each. A moment without a
    time has a boost of 0, as has any where the calendar is empty.
    """
    known = calendar.where(F.col("held_at").isNotNull() & F.col("boost").isNotNull() & (F.col("width") > 0))
    middle, reach = _day(F.col("held_at")), F.ceil(F.col("width") * REACH) + 1
    bins = known.select(
        F.struct("held_at", "boost", "width").alias("entry"),
        F.explode(F.sequence(F.floor((middle - reach) / bin_days), F.floor((middle + reach) / bin_days))).alias("__bin")) \
        .groupBy("__bin").agg(F.sort_array(F.collect_list("entry")).alias("__near"))
    away = lambda e: F.abs(F.timestamp_diff("SECOND", e["held_at"], F.col(at))) / DAY_SECONDS
    total = F.aggregate("__near", F.lit(0.0), lambda sum_, e: sum_ + e["boost"] * F.exp(
        F.lit(-0.5) * F.pow(away(e) / e["width"], F.lit(2.0))))
    placed = moments.withColumn("__bin", F.floor(_day(F.col(at)) / bin_days))
    return placed.join(bins, "__bin", "left").select(*moments.columns, F.coalesce(total, F.lit(0.0)).alias(name))
