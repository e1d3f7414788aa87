"""Table rules and cross-table rules: each is broken once and must be named."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from feedloom.fixed_values import INTEGRITY_RULES
from feedloom.operators.integrity import IntegrityError, check_integrity, integrity_report
from feedloom.operators.validate import ValidationError, check_tables, schema_report, validate_table
from feedloom.schemas import TABLES, conform

T = datetime


def base(spark):
    rows = {
        "customers": [("C0000001", "A", "B", "a@b.c", "1", "s", "c", "p", "Canada", "en_CA", "female",
                       date(1980, 6, 1), T(2025, 1, 1), 1)],
        "products": [("P001", "s1", "Kettle", "grills", "d", 10.0, None, date(2020, 1, 1)),
                     ("P002", "s2", "Stove", "accessories", "d", 20.0, "gas", date(2020, 1, 1))],
        "orders": [("O000000001", "C0000001", T(2025, 2, 1), 30.0, 1)],
        "order_lines": [("L0000000001", "O000000001", "P001", 1, 10.0, 10.0, 1),
                        ("L0000000002", "O000000001", "P002", 1, 20.0, 20.0, 1)],
        "reviews": [("R0000000001", "C0000001", "P001", "L0000000001", T(2025, 2, 10), 4, 1)],
        "review_texts": [("R0000000001", "h", "Fine.", "english", "w", T(2025, 3, 1))],
        "review_truth": [("R0000000001", 0.7, "performance", "english")],
    }
    return {name: spark.createDataFrame(r, TABLES[name].ddl) for name, r in rows.items()}


def set_to(column, value):
    return lambda df: df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))


BROKEN = {
    "order_customer": ("orders", set_to("customer_id", "C9999999")),
    "line_order": ("order_lines", lambda df: df.union(df.limit(1).withColumn("order_id", F.lit("O999999999")))),
    "line_product": ("order_lines", set_to("product_id", "P999")),
    "order_has_line": ("order_lines", lambda df: df.where("false")),
    "order_after_signup": ("orders", set_to("ordered_at", T(2024, 1, 1))),
    "order_total": ("orders", set_to("order_total", 31.0)),
    "review_customer": ("reviews", set_to("customer_id", "C9999999")),
    "review_product": ("reviews", set_to("product_id", "P999")),
    "review_line": ("reviews", set_to("order_line_id", "L9999999999")),
    "review_buyer": ("reviews", set_to("product_id", "P002")),
    "review_after_order": ("reviews", set_to("reviewed_at", T(2025, 1, 15))),
    "text_review": ("review_texts", set_to("review_id", "R9999999999")),
    "truth_review": ("review_truth", set_to("review_id", "R9999999999")),
}


def test_a_sound_dataset_breaks_nothing(spark):
    tables = base(spark)
    check_integrity(tables)
    check_tables(tables)
    report = integrity_report(tables).collect()
    assert {r.rule for r in report} == set(INTEGRITY_RULES.values()) and all(r.violations == 0 for r in report)


@pytest.mark.parametrize("rule", list(BROKEN))
def test_each_rule_is_named(spark, rule):
    table, change = BROKEN[rule]
    tables = base(spark)
    tables[table] = change(tables[table])
    with pytest.raises(IntegrityError) as caught:
        check_integrity(tables)
    assert INTEGRITY_RULES[rule] in caught.value.failures


def test_all_broken_rules_are_reported_at_once(spark):
    tables = base(spark)
    tables["orders"] = set_to("order_total", 31.0)(set_to("ordered_at", T(2024, 1, 1))(tables["orders"]))
    with pytest.raises(IntegrityError) as caught:
        check_integrity(tables)
    assert len(caught.value.failures) == 2


def test_rules_of_absent_tables_are_skipped(spark):
    tables = {k: v for k, v in base(spark).items() if k in ("customers", "orders")}
    assert {r.rule for r in integrity_report(tables).collect()} == \
        {INTEGRITY_RULES["order_customer"], INTEGRITY_RULES["order_after_signup"]}


def test_a_hot_orphan_key_is_counted_whole_and_sampled_once(spark):
    tables = base(spark)
    lines = spark.range(3000).select(F.lit("L").alias("order_line_id"),
                                     F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("order_id"),
                                     F.lit("P001").alias("product_id"), F.lit(1.0).alias("line_total"))
    row = integrity_report({"orders": tables["orders"], "order_lines": lines}, rules=["line_order"]).first()
    assert row.violations == 3000
    assert row["sample"] == ";".join(sorted(str(i) for i in range(3000) if i % 3)[:5])


@pytest.mark.parametrize("table, column, value, rule", [
    ("customers", "customer_id", "X1", "customer_id matches its pattern"),
    ("customers", "email", "no address", "email matches its pattern"),
    ("customers", "country", "Atlantis", "country is a known value"),
    ("products", "list_price", 0.0, "list_price is in range"),
    ("order_lines", "line_total", 25.0, "line_total_is_quantity_times_price"),
    ("reviews", "rating", 6, "rating is in range"),
    ("reviews", "reviewed_at", None, "reviewed_at is present"),
    ("review_texts", "review_text", "", "review_text is long enough"),
    ("review_truth", "satisfaction", 1.5, "satisfaction is in range"),
])
def test_value_rules(spark, table, column, value, rule):
    df = set_to(column, value)(base(spark)[table])
    broken = {r.rule: r.violations for r in validate_table(df, TABLES[table]).collect() if r.violations}
    assert set(broken) == {rule}


def test_line_total_to_the_cent(spark):
    df = set_to("line_total", 19.98)(set_to("unit_price", 9.99)(set_to("quantity", 2)(base(spark)["order_lines"])))
    assert all(r.violations == 0 for r in validate_table(df, TABLES["order_lines"]).collect())


def test_a_shared_key_and_a_null_fuel(spark):
    products = base(spark)["products"]
    twice = {r.rule: r.violations for r in validate_table(products.union(products.limit(1)), TABLES["products"]).collect()}
    assert twice["product_id is unique"] == 2 and twice["fuel_type is a known value"] == 0


def test_columns_are_strict(spark):
    orders = base(spark)["orders"]
    assert schema_report(orders, TABLES["orders"]).count() == 0
    odd = orders.drop("batch_id").withColumn("note", F.lit("x")).withColumn("order_total", F.col("order_total").cast("int"))
    assert {(r.column, r.expected, r.found) for r in schema_report(odd, TABLES["orders"]).collect()} == {
        ("batch_id", "int", None), ("note", None, "string"), ("order_total", "double", "int")}
    with pytest.raises(ValidationError, match="orders.note"):
        check_tables({"orders": odd})
    assert schema_report(conform(odd, TABLES["orders"].ddl), TABLES["orders"]).count() == 0
