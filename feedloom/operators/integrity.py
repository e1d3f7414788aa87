"""The rules that span tables: every broken rule is reported, with how often and sample keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import INTEGRITY_RULES

SAMPLES = 5


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(key, rows): values of `key` in the child that the parent lacks. Equal keys are counted before the join."""
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return keys.join(parent.select(key), key, "left_anti").select(F.col(key).cast("string").alias("key"), "rows")


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.lit(1).cast("bigint").alias("rows"))


def _before_signup(t: dict[str, DataFrame]) -> DataFrame:
    people = t["customers"].select("customer_id", "signup_at")
    return _keyed(t["orders"].join(people, "customer_id").where("ordered_at < signup_at"), "order_id")


def _wrong_total(t: dict[str, DataFrame]) -> DataFrame:
    sums = t["order_lines"].groupBy("order_id").agg(F.sum("line_total").alias("lines"))
    return _keyed(t["orders"].join(sums, "order_id").where("abs(order_total - lines) >= 0.005"), "order_id")


def _reviewed(t: dict[str, DataFrame]) -> DataFrame:
    lines = t["order_lines"].select("order_line_id", "order_id", F.col("product_id").alias("line_product"))
    orders = t["orders"].select("order_id", F.col("customer_id").alias("buyer"), "ordered_at")
    return t["reviews"].select("review_id", "order_line_id", "product_id", "customer_id", "reviewed_at") \
        .join(lines, "order_line_id").join(orders, "order_id")


def _wrong_buyer(t: dict[str, DataFrame]) -> DataFrame:
    return _keyed(_reviewed(t).where("product_id <> line_product OR customer_id <> buyer"), "review_id")


def _too_early(t: dict[str, DataFrame]) -> DataFrame:
    return _keyed(_reviewed(t).where("reviewed_at <= ordered_at"), "review_id")


# rule -> (tables it needs, how to find what breaks it)
FINDERS = {
    "order_customer": (("orders", "customers"), lambda t: orphans(t["orders"], t["customers"], "customer_id")),
    "line_order": (("order_lines", "orders"), lambda t: orphans(t["order_lines"], t["orders"], "order_id")),
    "line_product": (("order_lines", "products"), lambda t: orphans(t["order_lines"], t["products"], "product_id")),
    "order_has_line": (("orders", "order_lines"), lambda t: orphans(t["orders"], t["order_lines"], "order_id")),
    "order_after_signup": (("orders", "customers"), _before_signup),
    "order_total": (("orders", "order_lines"), _wrong_total),
    "review_customer": (("reviews", "customers"), lambda t: orphans(t["reviews"], t["customers"], "customer_id")),
    "review_product": (("reviews", "products"), lambda t: orphans(t["reviews"], t["products"], "product_id")),
    "review_line": (("reviews", "order_lines"), lambda t: orphans(t["reviews"], t["order_lines"], "order_line_id")),
    "review_buyer": (("reviews", "order_lines", "orders"), _wrong_buyer),
    "review_after_order": (("reviews", "order_lines", "orders"), _too_early),
    "text_review": (("review_texts", "reviews"), lambda t: orphans(t["review_texts"], t["reviews"], "review_id")),
    "truth_review": (("review_truth", "reviews"), lambda t: orphans(t["review_truth"], t["reviews"], "review_id")),
}


def violations(tables: dict[str, DataFrame], rules: list[str] | None = None) -> DataFrame:
    """(rule, key, rows) for everything that breaks a rule. Rules whose tables are absent are skipped."""
    found = [find(tables).select(F.lit(INTEGRITY_RULES[name]).alias("rule"), "key", "rows")
             for name, (needs, find) in FINDERS.items()
             if (rules is None or name in rules) and all(n in tables for n in needs)]
    if not found:
        raise ValueError("no rule has all its tables")
    return reduce(DataFrame.unionByName, found)


def integrity_report(tables: dict[str, DataFrame], *, rules: list[str] | None = None,
                     samples: int = SAMPLES) -> DataFrame:
    """(rule, violations, sample): one row per checked rule, with its smallest offending keys."""
    spark = next(iter(tables.values())).sparkSession
    checked = [(INTEGRITY_RULES[name],) for name, (needs, _) in FINDERS.items()
               if (rules is None or name in rules) and all(n in tables for n in needs)]
    # per key first: a rule that nearly every row breaks is counted before it is gathered
    # (every key has rows; asking for them lets both uses below share one shuffle)
    per_key = violations(tables, rules).groupBy("rule", "key").agg(F.sum("rows").alias("rows")).where("rows > 0")
    counted = per_key.groupBy("rule").agg(F.sum("rows").alias("violations"))
    first = per_key.select("rule", "key", F.row_number().over(Window.partitionBy("rule").orderBy("key")).alias("n")) \
        .where(F.col("n") <= samples)
    sampled = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("key")), ";").alias("sample"))
    return spark.createDataFrame(checked, "rule STRING").join(counted, "rule", "left").join(sampled, "rule", "left") \
        .select("rule", F.coalesce("violations", F.lit(0)).alias("violations"),
                F.coalesce("sample", F.lit("")).alias("sample"))


class IntegrityError(ValueError):
    """Raised with every broken rule; `failures` maps each to its sample."""

    def __init__(self, failures: dict[str, str]):
        self.failures = failures
        super().__init__("broken rules: " + "; ".join(f"{rule} (e.g. {keys})" for rule, keys in failures.items()))


def check_integrity(tables: dict[str, DataFrame], *, rules: list[str] | None = None) -> None:
    """Raise if a cross-table rule, or one of `rules`, is broken. Runs jobs; at most a row per rule reaches the driver."""
    broken = integrity_report(tables, rules=rules).where("violations > 0").collect()
    if broken:
        raise IntegrityError({r.rule: r["sample"] for r in broken})
