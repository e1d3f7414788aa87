"""Views over reviews and customers: risk, latest review per customer, flows, headline numbers, queues."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    AT_RISK_FRUSTRATION,
    EXCERPT_LENGTH,
    FLOW_LEVELS,
    FRUSTRATED_FRUSTRATION,
    NO_ISSUE,
    NO_ISSUE_LABEL,
    RISK_TIERS,
    SENTIMENTS,
)
from feedloom.operators.prefix import earlier, hash_slice
from feedloom.operators.quantiles import exact_quantile

AT_RISK, FRUSTRATED, SATISFIED = RISK_TIERS


def assign_risk(frame: DataFrame, *, at_risk_frustration: float = AT_RISK_FRUSTRATION,
                frustrated_frustration: float = FRUSTRATED_FRUSTRATION) -> DataFrame:
    """Add `risk_tier`: a churn signal or high peak frustration is at risk."""
    peak = F.col("peak_frustration")
    return frame.withColumn("risk_tier", F.when(F.col("churn_risk") | (peak >= at_risk_frustration), AT_RISK)
                            .when(peak >= frustrated_frustration, FRUSTRATED).otherwise(SATISFIED))


def customers_view(reviews: DataFrame) -> DataFrame:
    """One row per customer: their latest review, and how many they wrote. Drop long texts before calling."""
    latest = F.max_by(F.struct(*reviews.columns), F.struct("reviewed_at", "review_id"))
    return reviews.groupBy("customer_id").agg(latest.alias("r"), F.count(F.lit(1)).alias("reviews_written")) \
        .select("r.*", "reviews_written")


def sankey_links(reviews: DataFrame, sentiment: str = "text_sentiment") -> DataFrame:
    """Review counts per hop sentiment -> category -> product -> issue, each split by sentiment, in one aggregate."""
    at = dict(zip(FLOW_LEVELS, [sentiment, "product_category", "product_name", "primary_issue"], strict=True))
    hops = F.array(*[
        F.struct(F.lit(a).alias("source_level"), F.col(at[a]).alias("source"),
                 F.lit(b).alias("target_level"), F.col(at[b]).alias("target"))
        for a, b in pairwise(FLOW_LEVELS)])
    return reviews.select(F.col(sentiment).alias("sentiment"), F.inline(hops)) \
        .groupBy("source_level", "source", "target_level", "target", "sentiment") \
        .agg(F.count(F.lit(1)).alias("reviews"))


def sankey_nodes(links: DataFrame) -> DataFrame:
    """Every node once, sized by what flows into it (out of it at the first level), with its drawing position.

    Nodes that tie are placed by the hash of their name, which also cuts the ranking into even slices,
    so a catalogue of any size is numbered without sorting it in one task.
    """
    first = FLOW_LEVELS[0]
    ends = links.select("reviews", F.inline(F.array(
        F.struct(F.col("target_level").alias("level"), F.col("target").alias("name")),
        F.struct(F.when(F.col("source_level") == first, first).alias("level"), F.col("source").alias("name")),
    ))).where(F.col("level").isNotNull())
    rank = F.array_position(F.array(*[F.lit(x) for x in FLOW_LEVELS]), F.col("level"))
    mood = F.array_position(F.array(*[F.lit(x) for x in SENTIMENTS]), F.col("name"))
    placed = ends.groupBy("level", "name").agg(F.sum("reviews").alias("reviews")).withColumns({
        "__level": rank, "__mood": F.when(mood > 0, mood).otherwise(9), "__last": F.col("name") == NO_ISSUE,
        "__size": -F.col("reviews"), "__tie": F.md5("name"), "__one": F.lit(1)})
    # three ranks are added: of the doublings of size (a few hundred rows at any scale), of the sizes inside a doubling
    # (at most the root of twice the reviews), and of the nodes of one size, sliced by hash
    bands, sizes = ["__level", "__mood", "__last", "__band"], ["__level", "__mood", "__last", "__band", "__size"]
    banded = placed.withColumn("__band", -F.floor(F.log2("reviews")))
    sliced = banded.withColumn("__slice", hash_slice(F.col("__tie"), 3))
    among = earlier(sliced, by=sizes, slice_by="__slice", order=[F.col("__tie")], sums=["__one"], busy_rows=0)
    before = (Window.unboundedPreceding, -1)
    per_size = banded.groupBy(*sizes).agg(F.count(F.lit(1)).alias("nodes"))
    larger = per_size.select(*sizes, F.sum("nodes").over(
        Window.partitionBy(*bands).orderBy("__size").rowsBetween(*before)).alias("__larger"))
    per_band = per_size.groupBy(*bands).agg(F.sum("nodes").alias("nodes"))
    ahead = per_band.select(*bands, F.sum("nodes").over(Window.orderBy(*bands).rowsBetween(*before)).alias("__ahead"))
    index = F.coalesce("__ahead", F.lit(0)) + F.coalesce("__larger", F.lit(0)) + F.col("__one_before")
    return among.join(larger, sizes).join(ahead, bands).select(index.alias("index"), "level", "name", "reviews")


def sankey_conservation(links: DataFrame) -> DataFrame:
    """Reviews leaving each level: equal at every hop."""
    return links.groupBy("source_level").agg(F.sum("reviews").alias("reviews"))


def filtered_view(reviews: DataFrame, *, categories: list[str] | None = None, products: list[str] | None = None,
                  countries: list[str] | None = None, sentiments: list[str] | None = None,
                  sentiment: str = "text_sentiment", hide_no_issue: bool = False) -> DataFrame:
    """Reviews under the dashboard's filters; an empty filter lets everything through."""
    chosen = {"product_category": categories, "product_name": products, "country": countries, sentiment: sentiments}
    for column, values in chosen.items():
        if values:
            reviews = reviews.where(F.col(column).isin(values))
    return reviews.where(F.col("primary_issue") != NO_ISSUE) if hide_no_issue else reviews


def filter_options(reviews: DataFrame) -> DataFrame:
    """The values each filter offers, as (filter, value)."""
    offered = [F.struct(F.lit(c).alias("filter"), F.col(c).alias("value"))
               for c in ("product_category", "product_name", "country")]
    return reviews.select(F.inline(F.array(*offered))).distinct()


def kpis(reviews: DataFrame, sentiment: str = "text_sentiment") -> DataFrame:
    """One row of headline numbers over reviews that have a risk tier; customers count by their latest review.

    Reviews are counted per customer on the way, so one pass gives both the review and the customer numbers.
    """
    latest = F.max_by(F.struct("risk_tier", "lifetime_revenue"), F.struct("reviewed_at", "review_id"))
    people = reviews.groupBy("customer_id").agg(
        latest.alias("r"), F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col(sentiment) == "negative").alias("negative")).select("r.*", "reviews", "negative")
    at_risk = F.col("risk_tier") == AT_RISK
    totals = people.agg(
        F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"), F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_reviews"), F.count_if(at_risk).alias("customers_at_risk"),
        F.sum(F.when(at_risk, F.col("lifetime_revenue")).otherwise(0.0)).alias("at_risk_revenue"),
        F.sum("lifetime_revenue").alias("revenue"))
    return totals.select(
        "reviews", "customers", "negative_reviews",
        F.round(F.try_divide("negative_reviews", "reviews"), 4).alias("negative_share"), "customers_at_risk",
        F.round(F.try_divide("customers_at_risk", "customers"), 4).alias("at_risk_share"),
        F.round("at_risk_revenue", 2).alias("revenue_at_risk"),
        F.round(F.try_divide("at_risk_revenue", "revenue"), 4).alias("revenue_at_risk_share"))


def pretty(label: str | Column) -> Column:
    """`build_quality` -> `Build quality`."""
    c = F.col(label) if isinstance(label, str) else label
    words = F.replace(c, F.lit("_"), F.lit(" "))
    return F.when(c == NO_ISSUE, NO_ISSUE_LABEL).otherwise(
        F.concat(F.upper(F.substring(words, 1, 1)), F.lower(words.substr(F.lit(2), F.length(words)))))


def excerpt(text: str) -> Column:
    """The start of a text for a hover label; the text itself stays whole."""
    return F.substring(text, 1, EXCERPT_LENGTH)


def issue_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per primary issue, with the issue's label."""
    return reviews.groupBy("primary_issue").agg(F.count(F.lit(1)).alias("reviews")) \
        .withColumn("label", pretty("primary_issue"))


def issue_drilldown(reviews: DataFrame, issue: str, product: str | None = None) -> DataFrame:
    """The reviews behind one issue, most frustrated first."""
    chosen = reviews.where(F.col("primary_issue") == issue)
    if product is not None:
        chosen = chosen.where(F.col("product_name") == product)
    return chosen.orderBy(F.desc("peak_frustration"), "review_id")


def at_risk_customers(customers: DataFrame) -> DataFrame:
    """Customers at risk, most valuable first."""
    return customers.where(F.col("risk_tier") == AT_RISK).orderBy(F.desc("lifetime_revenue"), "customer_id")


def with_quadrant(customers: DataFrame) -> DataFrame:
    """Add `tenure` and `value`: on which side of the median each customer is. Pass a stored table: it is read thrice."""
    tenure = exact_quantile(customers, "tenure_days").scalar()
    revenue = exact_quantile(customers, "lifetime_revenue").scalar()
    sided = customers.select("*", tenure.alias("median_tenure"), revenue.alias("median_revenue"))
    return sided.withColumns({
        "tenure": F.when(F.col("tenure_days") < F.col("median_tenure"), "newer").otherwise("longer-standing"),
        "value": F.when(F.col("lifetime_revenue") < F.col("median_revenue"), "lower").otherwise("higher")})


def value_quadrants(customers: DataFrame) -> DataFrame:
    """Customers per quadrant and risk tier, with the two medians that part them."""
    return with_quadrant(customers).groupBy("tenure", "value", "risk_tier", "median_tenure", "median_revenue").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("lifetime_revenue"), 2).alias("revenue"))
