"""Totals over everything earlier, without ever putting a whole busy key into one task.

A plain window partitioned by key sorts all rows of a key in one task, so a key that holds a third
of the table stalls the job. Here the history of a busy key is cut into slices of its ordering (a day,
a hash range). Rows are accumulated inside their slice, slice totals are accumulated per key, and the
two are added. Other keys are one slice each and cost what a plain window costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUSY_ROWS = 1_000_000  # of one key in one task; a matter of speed only
DIGITS = 6  # decimal places in which fractions are added


def earlier(df: DataFrame, *, by: Sequence[str], slice_by: str, order: Sequence[Column],
            sums: Sequence[str] = (), maxima: Sequence[str] = (), busy_rows: int = BUSY_ROWS,
            counted: DataFrame | None = None) -> DataFrame:
    """Add `<column>_before` for each of `sums` and `maxima`: the aggregate over rows earlier in `order`.

    `slice_by` must never decrease along `order`, and `order` must be unique within `by`. Sums are 0 and
    maxima null where nothing is earlier. A key with more than `busy_rows` rows is sliced; `counted` may hold
    other rows of the same keys to count instead, at least as many as `df` has: where `df` is an aggregate,
    what it was made from. Slicing changes no result: fractions are added as decimals of DIGITS places, whose
    sums do not depend on the order.
    """
    columns, kinds = df.columns, dict(df.dtypes)
    broken = {c for c in sums if kinds[c] in ("double", "float")}
    exact = {c: F.col(c).cast(f"decimal(28,{DIGITS})") if c in broken else F.col(c) for c in sums}
    busy = (df if counted is None else counted).groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")) \
        .where(F.col("__rows") > busy_rows)
    df = df.join(busy, list(by), "left") \
        .withColumn("__part", F.when(F.col("__rows").isNotNull(), F.col(slice_by))).drop("__rows")
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*",
                      *[F.sum(exact[c]).over(inside).alias(f"{c}__inside") for c in sums],
                      *[F.max(c).over(inside).alias(f"{c}__inside") for c in maxima])
    offsets = (
        df.where(F.col("__part").isNotNull()).groupBy(*by, "__part")
        .agg(*[F.sum(exact[c]).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])
        .select(*by, "__part",
                *[F.sum(c).over(across).alias(f"{c}__offset") for c in sums],
                *[F.max(c).over(across).alias(f"{c}__offset") for c in maxima])
    )
    zero = F.lit(0)
    total = {c: F.coalesce(f"{c}__inside", zero) + F.coalesce(f"{c}__offset", zero) for c in sums}
    return local.join(offsets, [*by, "__part"], "left").select(
        *columns,
        *[(total[c].cast("double") if c in broken else total[c]).alias(f"{c}_before") for c in sums],
        *[F.greatest(f"{c}__inside", f"{c}__offset").alias(f"{c}_before") for c in maxima],
    )


def hash_slice(column: Column, digits: int = 3) -> Column:
    """Slice of a hex hash: its first `digits`, which split any group evenly into 16^digits parts."""
    return F.substring(column, 1, digits)
