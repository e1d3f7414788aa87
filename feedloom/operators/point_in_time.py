"""Features as at a moment: only what happened strictly before it counts.

Rows and events are first reduced to moments, one row per (entity, time), which a map-side aggregate
does before anything is shuffled. `earlier` then accumulates the moments, and the answer for a moment
is joined back to every row at it. Nothing is compared pairwise, there is no range join, and neither
a busy entity nor a busy moment is ever held by one task: an entity with more than `busy_rows` moments
is cut into slices of `slice_seconds`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import DAYS_PER_YEAR
from feedloom.operators.prefix import BUSY_ROWS, earlier

DAY = 86_400
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from `start` to `end` (the session runs in UTC)."""
    return F.timestamp_diff("SECOND", start, end)


def time_slice_of(column: str, seconds: int) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.expr(EPOCH), F.col(column)) / F.lit(seconds))


@dataclass(frozen=True)
class History:
    """One event table and what to know of it: `sums` maps output name to event column."""

    events: DataFrame
    time: str
    sums: dict[str, str] = field(default_factory=dict)
    count: str | None = None
    last: str | None = None


def as_of(left: DataFrame, histories: Sequence[History], *, by: str, at: str, slice_seconds: int = DAY,
          busy_rows: int = BUSY_ROWS) -> DataFrame:
    """`left` plus what each history held for the same `by` strictly before `left[at]`, in one pass."""
    sums = [name for h in histories for name in h.sums]
    counts = [h.count or f"__n{i}" for i, h in enumerate(histories)]
    lasts = [h.last for h in histories if h.last]

    def moments_of(df: DataFrame, time: str, values: dict[str, Column]) -> DataFrame:
        known = df.where(F.col(by).isNotNull() & F.col(time).isNotNull())
        return known.select(
            F.col(by).alias("__by"), F.col(time).alias("__at"),
            *[values.get(c, F.lit(0.0)).cast("double").alias(c) for c in sums],
            *[values.get(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
            *[values.get(c, F.lit(None)).cast("timestamp_ntz").alias(c) for c in lasts])

    parts = [moments_of(left, at, {})]
    for i, h in enumerate(histories):
        values = {out: F.coalesce(F.col(src), F.lit(0)) for out, src in h.sums.items()}
        values[counts[i]] = F.lit(1)
        if h.last:
            values[h.last] = F.col(h.time)
        parts.append(moments_of(h.events, h.time, values))
    rows = reduce(DataFrame.unionByName, parts)
    moments = (
        rows.groupBy("__by", "__at")
        .agg(*[F.sum(c).alias(c) for c in [*sums, *counts]], *[F.max(c).alias(c) for c in lasts])
        .withColumn("__slice", time_slice_of("__at", slice_seconds))
    )
    known = earlier(moments, by=["__by"], slice_by="__slice", order=[F.col("__at")], sums=[*sums, *counts],
                    maxima=lasts, busy_rows=busy_rows, counted=rows)
    named = [h.count for h in histories if h.count]
    answers = known.select("__by", "__at", *[F.col(f"{c}_before").alias(c) for c in [*sums, *named, *lasts]])
    joined = left.join(answers, (left[by] == answers["__by"]) & (left[at] == answers["__at"]), "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*sums, *named]], *lasts)


def point_in_time(left: DataFrame, events: DataFrame, *, by: str, at: str, event_time: str,
                  sums: dict[str, str] | None = None, count: str | None = None, last_event: str | None = None,
                  slice_seconds: int = DAY, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """`left` plus totals, count and last time of the same entity's events strictly before `left[at]`."""
    history = History(events, event_time, sums or {}, count, last_event)
    return as_of(left, [history], by=by, at=at, slice_seconds=slice_seconds, busy_rows=busy_rows)


def running_totals(events: DataFrame, *, by: str, at: str, sums: dict[str, str], count: str,
                   slice_seconds: int = DAY, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """One row per (entity, time): totals and count up to and including that time."""
    rows = events.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    moments = (
        rows.groupBy(by, at)
        .agg(*[F.sum(F.coalesce(F.col(src), F.lit(0))).alias(out) for out, src in sums.items()],
             F.count(F.lit(1)).alias(count))
        .withColumn("__slice", time_slice_of(at, slice_seconds))
    )
    names = [*sums, count]
    known = earlier(moments, by=[by], slice_by="__slice", order=[F.col(at)], sums=names, busy_rows=busy_rows,
                    counted=rows)
    return known.select(by, at, *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in names])


FEATURES = ["tenure_days", "lifetime_revenue", "order_count", "days_since_last_order", "previous_reviews", "age",
            "gender", "country"]


def review_features(reviews: DataFrame, customers: DataFrame, orders: DataFrame, *,
                    slice_seconds: int = DAY, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """One row per review: what was known of its customer when it was written.

    Orders and the customer's own earlier reviews are accumulated in the same pass.
    """
    base = reviews.select("review_id", "customer_id", "reviewed_at")
    known = as_of(base, [
        History(orders, "ordered_at", {"lifetime_revenue": "order_total"}, "order_count", "last_order_at"),
        History(base, "reviewed_at", count="previous_reviews"),
    ], by="customer_id", at="reviewed_at", slice_seconds=slice_seconds, busy_rows=busy_rows)
    people = customers.select("customer_id", "signup_at", "date_of_birth", "gender", "country")
    return known.join(people, "customer_id").select(
        "review_id", "customer_id",
        (seconds_between("signup_at", "reviewed_at") / DAY).alias("tenure_days"),
        F.round("lifetime_revenue", 2).alias("lifetime_revenue"),
        "order_count",
        (seconds_between("last_order_at", "reviewed_at") / DAY).alias("days_since_last_order"),
        "previous_reviews",
        F.floor(F.datediff(F.col("reviewed_at").cast("date"), "date_of_birth") / DAYS_PER_YEAR).cast("int").alias("age"),
        "gender", "country")


def leakage_check(reviews: DataFrame, customers: DataFrame, orders: DataFrame, future_orders: DataFrame,
                  future_reviews: DataFrame) -> DataFrame:
    """One row: reviews, and how many of their features change when later events are added (0 expected)."""
    before = review_features(reviews, customers, orders)
    grown = reviews.select("review_id", "customer_id", "reviewed_at").unionByName(
        future_reviews.select("review_id", "customer_id", "reviewed_at"))
    after = review_features(grown, customers, orders.select("customer_id", "ordered_at", "order_total").unionByName(
        future_orders.select("customer_id", "ordered_at", "order_total")))
    moved = F.lit(False)
    for c in FEATURES:
        moved = moved | ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    return before.alias("b").join(after.alias("a"), "review_id").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(moved).alias("changed"))
