"""The dashboard's headline numbers for every choice of filters, from one pass over the reviews.

Reviews are first reduced to one row per customer and finest cell, holding counts and the customer's latest review
there; only these rows are expanded into the sets of filters. A customer counts once in every cell, by the latest review
among those the cell's filters let through, as `dashboard.kpis` counts under `dashboard.filtered_view`.

A cell stands for one chosen value per filter; counts of customers do not add up over cells, so a filter of several
values goes through `filtered_view`. A null value is a value of its own and never mistaken for an unset filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import NO_ISSUE
from feedloom.operators.dashboard import AT_RISK

FILTERS = ("product_category", "product_name", "country", "text_sentiment")
RAISED = "issue_raised"
NUMBERS = {"reviews": "bigint", "negative_reviews": "bigint", "customers": "bigint", "customers_at_risk": "bigint",
           "revenue_at_risk": "decimal(28,2)", "revenue": "decimal(28,2)"}


def sets_of(filters: Sequence[str]) -> list[list[str]]:
    """Every subset of the filters, the empty one first."""
    return [list(chosen) for k in range(len(filters) + 1) for chosen in combinations(filters, k)]


def kpi_cube(reviews: DataFrame, filters: Sequence[str] = FILTERS, sentiment: str = "text_sentiment") -> DataFrame:
    """One row per set of filters (`filters`, their names joined by +, in order; with `issue_raised` at the end where
    reviews without an issue are hidden) and values: `NUMBERS`. Filters that are not set hold null. No reviews give
    no rows. Amounts are added as decimals of two digits, so the order of adding does not show.
    """
    filters = list(filters)
    moment = F.struct("reviewed_at", "review_id")
    here = F.struct(moment.alias("moment"), "risk_tier", F.col("lifetime_revenue").cast("decimal(18,2)").alias("revenue"))
    finest = reviews.withColumn(RAISED, F.col("primary_issue") != NO_ISSUE).groupBy(*filters, RAISED, "customer_id").agg(
        F.max_by(here, moment).alias("last"), F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col(sentiment) == "negative").alias("negative"))
    names = F.concat_ws("+", *[F.when(F.grouping(c) == 0, c) for c in (*filters, RAISED)])
    wanted = [[*chosen, *extra, "customer_id"] for extra in ([], [RAISED]) for chosen in sets_of(filters)]
    people = finest.groupingSets([[F.col(c) for c in s] for s in wanted], *filters, RAISED, "customer_id").agg(
        names.alias("filters"), F.grouping(RAISED).alias("open"), F.max_by("last", "last.moment").alias("last"),
        F.sum("reviews").alias("reviews"), F.sum("negative").alias("negative"))
    # of the sets that look at the issue, only the side with one is a choice of the dashboard
    shown = people.where((F.col("open") == 1) | F.col(RAISED))
    at_risk = F.col("last.risk_tier") == AT_RISK
    totals = {"reviews": F.sum("reviews"), "negative_reviews": F.sum("negative"), "customers": F.count(F.lit(1)),
              "customers_at_risk": F.count_if(at_risk),
              "revenue_at_risk": F.sum(F.when(at_risk, F.col("last.revenue")).otherwise(0)),
              "revenue": F.sum("last.revenue")}
    return shown.groupBy("filters", *filters).agg(*[totals[c].cast(t).alias(c) for c, t in NUMBERS.items()])


def kpis_from_cube(cube: DataFrame, chosen: Mapping[str, str | None], *, hide_no_issue: bool = False) -> DataFrame:
    """The row `dashboard.kpis` gives under these filters, looked up in the cube; zeros and nulls where no review is."""
    filters = [c for c in cube.columns if c not in NUMBERS and c != "filters"]
    unknown = set(chosen) - set(filters)
    if unknown:
        raise ValueError(f"the cube has no filter {sorted(unknown)}")
    name = "+".join([*[c for c in filters if c in chosen], *([RAISED] if hide_no_issue else [])])
    cell = cube.where(F.col("filters") == name)
    for column, value in chosen.items():
        cell = cell.where(F.col(column).eqNullSafe(F.lit(value)))
    total = cell.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) if t == "bigint" else
                       F.sum(c).cast("double").alias(c) for c, t in NUMBERS.items()])

    def share(part: str, whole: str):
        return F.round(F.try_divide(part, whole), 4)

    return total.select("reviews", "customers", "negative_reviews",
                        share("negative_reviews", "reviews").alias("negative_share"), "customers_at_risk",
                        share("customers_at_risk", "customers").alias("at_risk_share"), "revenue_at_risk",
                        share("revenue_at_risk", "revenue").alias("revenue_at_risk_share"))
