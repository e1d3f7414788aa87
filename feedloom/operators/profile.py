"""What the orders look like: seasons, repeat purchase, affinity, launch dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.operators.quantiles import quantiles_of_counts
from feedloom.session import materialise

TASK_PAIRS = 2_000_000  # pairs of products that one task forms or counts; results do not depend on it


def monthly_share(orders: DataFrame, customers: DataFrame, southern: list[str], *, since: str | None = None,
                  until: str | None = None) -> DataFrame:
    """Orders per hemisphere and month, with the month's share of its hemisphere."""
    kept = orders
    if since is not None:
        kept = kept.where(F.col("ordered_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        kept = kept.where(F.col("ordered_at") < F.lit(until).cast("timestamp_ntz"))
    # per customer and month first: a customer with very many orders meets the join as twelve rows
    per_customer = kept.groupBy("customer_id", F.month("ordered_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    where = customers.select("customer_id", F.col("country").isin(southern).alias("southern"))
    counted = per_customer.join(where, "customer_id").groupBy("southern", "month").agg(F.sum("n").alias("orders"))
    whole = F.sum("orders").over(Window.partitionBy("southern"))  # twelve rows each
    return counted.select("southern", "month", "orders", F.round(F.col("orders") / whole, 4).alias("share"))


def repeat_purchase(orders: DataFrame, order_lines: DataFrame, products: list) -> DataFrame:
    """One row: buyers of any of `products`, and the median number of their orders that hold one."""
    chosen = order_lines.where(F.col("product_id").isin(products)).select("order_id").distinct()
    per_customer = orders.select("order_id", "customer_id").join(chosen, "order_id", "left_semi") \
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    return quantiles_of_counts(per_customer.withColumn("all", F.lit(1)), ["all"], "orders", {"median_orders": 0.5}) \
        .drop("all")


def affinity_lift(orders: DataFrame, order_lines: DataFrame, products: DataFrame, bought: Column, also: Column) -> DataFrame:
    """One row: the share of buyers of `bought` that also buy `also`, against the share of all customers.

    Both conditions are over product columns. Each customer is reduced to two flags; no pairs are formed.
    """
    kinds = products.select("product_id", bought.alias("first"), also.alias("second")).where("first OR second")
    per_order = order_lines.select("order_id", "product_id").join(kinds, "product_id").groupBy("order_id").agg(
        F.bool_or("first").alias("first"), F.bool_or("second").alias("second"))
    flags = orders.select("order_id", "customer_id").join(per_order, "order_id", "left").groupBy("customer_id").agg(
        F.coalesce(F.bool_or("first"), F.lit(False)).alias("first"),
        F.coalesce(F.bool_or("second"), F.lit(False)).alias("second"))
    counts = flags.agg(F.count(F.lit(1)).alias("customers"), F.count_if("first").alias("buyers"),
                       F.count_if("second").alias("also_buyers"),
                       F.count_if(F.col("first") & F.col("second")).alias("both"))
    rate, base = F.try_divide("both", "buyers"), F.try_divide("also_buyers", "customers")
    others = F.try_divide(F.col("also_buyers") - F.col("both"), F.col("customers") - F.col("buyers"))
    return counts.select("customers", "buyers", "also_buyers", "both", F.round(rate, 4).alias("rate"),
                         F.round(base, 4).alias("base_rate"), F.round(others, 4).alias("rate_of_others"),
                         F.round(F.try_divide(rate, base), 4).alias("lift"))


def pair_tasks(spark: SparkSession, pairs: int | None, task_pairs: int) -> int:
    """Tasks for so many pairs, at least one for every core."""
    return max(spark.sparkContext.defaultParallelism, -(-(pairs or 0) // task_pairs))


def affinity_pairs(orders: DataFrame, order_lines: DataFrame, *, least: int, block_items: int = 256,
                   task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Pairs of products that at least `least` customers bought both of: (product_a < product_b) with buyers and lift.

    Products with fewer buyers are left out before pairs are formed. A customer of more than `block_items` such
    products is cut into blocks of products, and each pair of blocks is a group of its own, so no task holds all
    of a busy customer. Pairs are formed and counted in as many tasks as there are pairs for, about `task_pairs` each,
    so a task's memory does not grow with the tables. A repeated line counts once; rows with nulls do not.
    Lift is against independence among all customers with an order; no order lines give no row. Runs jobs.
    """
    bought = order_lines.select("order_id", "product_id").join(orders.select("order_id", "customer_id"), "order_id") \
        .select("customer_id", "product_id").dropna().distinct()
    buyers = bought.groupBy("product_id").agg(F.count(F.lit(1)).alias("buyers")).where(F.col("buyers") >= least)
    # read three times, and the number of pairs must be known before they are formed
    kept = materialise(bought.join(buyers.select("product_id"), "product_id", "left_semi"), "bought")
    of_customer = kept.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    formed = of_customer.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
    tasks = pair_tasks(orders.sparkSession, formed, task_pairs)
    blocks = kept.groupBy("customer_id").agg(F.ceil(F.count(F.lit(1)) / block_items).cast("int").alias("blocks")) \
        .where("blocks > 0")
    part, other = F.pmod(F.xxhash64("product_id"), "blocks").cast("int"), F.col("other")
    dealt = kept.join(blocks, "customer_id").withColumn("part", part).select(
        "customer_id", "product_id", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "customer_id", F.least("part", other).alias("low"), F.greatest("part", other).alias("high"), "part", "product_id") \
        .repartition(tasks, "customer_id", "low", "high")
    a, b = dealt.alias("a"), dealt.alias("b")
    # in a group of two blocks only pairs across them count; those inside a block meet in its own group
    pairs = a.join(b, F.expr("a.customer_id = b.customer_id AND a.low = b.low AND a.high = b.high "
                             "AND a.product_id < b.product_id AND (a.low = a.high OR a.part <> b.part)")) \
        .select(F.col("a.product_id").alias("product_a"), F.col("b.product_id").alias("product_b")) \
        .repartition(tasks, "product_a", "product_b").groupBy("product_a", "product_b") \
        .agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= least)
    everyone = orders.agg(F.count_distinct("customer_id").alias("customers"))  # one row
    of_a = buyers.select(F.col("product_id").alias("product_a"), F.col("buyers").alias("buyers_a"))
    of_b = buyers.select(F.col("product_id").alias("product_b"), F.col("buyers").alias("buyers_b"))
    expected = F.col("buyers_a") * F.col("buyers_b")
    lift = F.col("both").cast("double") * F.col("customers") / expected
    return pairs.join(of_a, "product_a").join(of_b, "product_b").crossJoin(everyone).select(
        "product_a", "product_b", "both", "buyers_a", "buyers_b", "customers", F.round(lift, 4).alias("lift"))


def sold_before_launch(orders: DataFrame, order_lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines for a product that was not launched yet."""
    return order_lines.select("order_line_id", "order_id", "product_id") \
        .join(orders.select("order_id", "ordered_at"), "order_id") \
        .join(products.select("product_id", "launched_on"), "product_id") \
        .where(F.col("ordered_at").cast("date") < F.col("launched_on"))
