"""Value rules per table and rules across tables, over the whole given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import GENDERS, INTEGRITY_RULES
from feedloom.operators import integrity, validate
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import check_sql, text
from feedloom.plans.registry import query
from feedloom.schemas import LINE_TOTAL_CHECK, TableSpec

NATIONS = [f"NATION_{i}" for i in range(20)]
KINDS = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD"]

SPECS = {
    "customers": TableSpec(
        "customer_id BIGINT, c_name STRING, country STRING, gender STRING, date_of_birth DATE, signup_at TIMESTAMP_NTZ",
        patterns={"c_name": r"^Customer#\d{9}$"}, unique=("customer_id",),
        members={"country": NATIONS, "gender": GENDERS}),
    "products": TableSpec(
        "product_id BIGINT, product_name STRING, category STRING, description STRING, brand STRING, "
        "list_price DOUBLE, launched_on DATE",
        patterns={"product_name": r"^[a-z]+ [a-z]+ \d+$"}, unique=("product_id", "product_name"),
        members={"category": KINDS}, ranges={"list_price": (0, 1000.0, True)}),
    "orders": TableSpec(
        "order_id BIGINT, customer_id BIGINT, ordered_at TIMESTAMP_NTZ, order_total DOUBLE, batch_id INT",
        unique=("order_id",), ranges={"order_total": (0, None, True), "batch_id": (1, 6, False)}),
    "order_lines": TableSpec(
        "order_line_id BIGINT, order_id BIGINT, product_id BIGINT, quantity INT, unit_price DOUBLE, line_total DOUBLE",
        unique=("order_line_id",), ranges={"quantity": (1, 49, False), "unit_price": (0, None, True)},
        row_checks={"line_total_is_quantity_times_price": LINE_TOTAL_CHECK}),
    "reviews": TableSpec(
        "review_id BIGINT, customer_id BIGINT, product_id BIGINT, order_line_id BIGINT, reviewed_at TIMESTAMP_NTZ, "
        "rating INT, batch_id INT",
        unique=("review_id", "order_line_id"), ranges={"rating": (1, 5, False), "batch_id": (1, 6, False)},
        nullable=()),
    "review_texts": TableSpec("review_id BIGINT, review_text STRING, language STRING, model STRING",
                              min_length={"review_text": 1}),
    "review_truth": TableSpec("review_id BIGINT, satisfaction DOUBLE, aspect STRING, language STRING",
                              unique=("review_id",), ranges={"satisfaction": (0.1, 0.7, False)}),
}
SQL_NAME = {"orders": "placed"}


def _all(d: Domain, only: str) -> DataFrame:
    parts = [validate.validate_values(d.tables[name], spec, only).select(F.lit(name).alias("table"), "rule", "violations")
             for name, spec in SPECS.items() if any(only in rule for rule in validate.value_rules(spec))]
    return reduce(DataFrame.unionByName, parts)


def _count_sql(rules: list[tuple[str, str, str]]) -> str:
    """(table, rule, condition of a broken row) as one SQL report."""
    body = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {text(rule)} AS rule, count(*) FILTER ({broken}) AS violations FROM {SQL_NAME.get(t, t)}"
        for t, rule, broken in rules)
    return check_sql(body, *dict.fromkeys(SQL_NAME.get(t, t) for t, _, _ in rules))


def _range_sql(column: str, bounds: tuple) -> str:
    low, high, exclusive = bounds
    parts = [] if low is None else [f"{column} {'<=' if exclusive else '<'} {low}"]
    return " OR ".join(parts + ([] if high is None else [f"{column} > {high}"]))


RANGES = [(t, f"{c} is in range", _range_sql(c, b)) for t, s in SPECS.items() for c, b in s.ranges.items()]
LENGTHS = [(t, f"{c} is long enough", f"length({c}) < {n}") for t, s in SPECS.items() for c, n in s.min_length.items()]
PATTERNS = [(t, f"{c} matches its pattern", f"NOT regexp_matches({c}, '{p}')") for t, s in SPECS.items()
            for c, p in s.patterns.items()]
MEMBERS = [(t, f"{c} is a known value", f"{c} NOT IN ({', '.join(map(text, v))})") for t, s in SPECS.items()
           for c, v in s.members.items()]
PRESENT = [(t, f"{c} is present", f"{c} IS NULL") for t, s in SPECS.items() for c in s.columns
           if c not in s.nullable]
ROW_CHECKS = [("order_lines", "line_total_is_quantity_times_price",
               "NOT (abs(round_even(quantity * unit_price, 2) - line_total) < 0.005::DOUBLE)")]


@query("validate_regex", _count_sql(PATTERNS))
def validate_regex(d: Domain):
    return _all(d, "matches its pattern")


@query("validate_isin", _count_sql(MEMBERS))
def validate_isin(d: Domain):
    return _all(d, "is a known value")


@query("validate_range", _count_sql(RANGES + LENGTHS))
def validate_range(d: Domain):
    return _all(d, "is in range").unionByName(_all(d, "is long enough"))


@query("validate_nulls", _count_sql(PRESENT))
def validate_nulls(d: Domain):
    return _all(d, "is present")


@query("validate_row_check", _count_sql(ROW_CHECKS))
def validate_row_check(d: Domain):
    return _all(d, "line_total_is")


UNIQUE = [(t, c) for t, s in SPECS.items() for c in s.unique]
UNIQUE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c} is unique' AS rule, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS violations FROM "
    f"(SELECT {c}, count(*) AS n FROM {SQL_NAME.get(t, t)} WHERE {c} IS NOT NULL GROUP BY 1)" for t, c in UNIQUE)
EVERY_TABLE = tuple(SQL_NAME.get(t, t) for t in SPECS)


@query("validate_unique", check_sql(UNIQUE_SQL, *EVERY_TABLE))
def validate_unique(d: Domain):
    parts = [validate.validate_unique(d.tables[t], list(s.unique)).select(F.lit(t).alias("table"), "rule", "violations")
             for t, s in SPECS.items() if s.unique]
    return reduce(DataFrame.unionByName, parts)


ALL_RULES = PATTERNS + MEMBERS + RANGES + LENGTHS + PRESENT + ROW_CHECKS


@query("validate_dataset", check_sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {text(r)} AS rule, count(*) FILTER ({b}) AS violations FROM {SQL_NAME.get(t, t)}"
        for t, r, b in ALL_RULES) + " UNION ALL " + UNIQUE_SQL + ")", *EVERY_TABLE))
def validate_dataset(d: Domain):
    return validate.validate_dataset(d.tables, SPECS)


def _orphans_sql(child: str, parent: str, key: str) -> str:
    return (f"SELECT {key}::VARCHAR AS key, 1::BIGINT AS n FROM {child} c "
            f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})")


REVIEWED = """(SELECT r.review_id, r.product_id, r.customer_id, r.reviewed_at, l.product_id AS line_product,
    o.customer_id AS buyer, o.ordered_at FROM reviews r JOIN order_lines l USING (order_line_id)
    JOIN placed o ON o.order_id = l.order_id)"""
BROKEN = {
    "order_customer": _orphans_sql("placed", "customers", "customer_id"),
    "line_order": _orphans_sql("order_lines", "placed", "order_id"),
    "line_product": _orphans_sql("order_lines", "products", "product_id"),
    "order_has_line": _orphans_sql("placed", "order_lines", "order_id"),
    "order_after_signup": "SELECT order_id::VARCHAR AS key, 1::BIGINT AS n FROM placed JOIN customers USING (customer_id) "
                          "WHERE ordered_at < signup_at",
    "order_total": "SELECT order_id::VARCHAR AS key, 1::BIGINT AS n FROM placed JOIN (SELECT order_id, sum(line_total) "
                   "AS lines FROM order_lines GROUP BY 1) USING (order_id) WHERE abs(order_total - lines) >= 0.005",
    "review_customer": _orphans_sql("reviews", "customers", "customer_id"),
    "review_product": _orphans_sql("reviews", "products", "product_id"),
    "review_line": _orphans_sql("reviews", "order_lines", "order_line_id"),
    "review_buyer": f"SELECT review_id::VARCHAR AS key, 1::BIGINT AS n FROM {REVIEWED} "
                    "WHERE product_id <> line_product OR customer_id <> buyer",
    "review_after_order": f"SELECT review_id::VARCHAR AS key, 1::BIGINT AS n FROM {REVIEWED} WHERE reviewed_at <= ordered_at",
    "text_review": _orphans_sql("review_texts", "reviews", "review_id"),
    "truth_review": _orphans_sql("review_truth", "reviews", "review_id"),
}


def _report_sql(rules: list[str]) -> str:
    body = " UNION ALL ".join(
        f"SELECT {text(INTEGRITY_RULES[r])} AS rule, coalesce(sum(n), 0)::BIGINT AS violations, "
        f"coalesce(array_to_string(list_sort(list(DISTINCT key))[1:5], ';'), '') AS sample FROM ({BROKEN[r]})"
        for r in rules)
    return check_sql(body, "customers", "products", "placed", "order_lines", "reviews", "review_texts", "review_truth")


def _register_integrity(name: str, rules: list[str]) -> None:
    @query(name, _report_sql(rules))
    def report(d: Domain):
        return integrity.integrity_report(d.tables, rules=rules)


_register_integrity("integrity_orphans", ["order_customer", "line_order", "line_product", "review_customer",
                                          "review_product", "review_line", "text_review", "truth_review"])
_register_integrity("integrity_every_parent_has_child", ["order_has_line"])
_register_integrity("integrity_time_order", ["order_after_signup", "review_after_order"])
_register_integrity("integrity_totals", ["order_total"])
_register_integrity("integrity_buyer_and_product", ["review_buyer"])
_register_integrity("integrity_report", list(INTEGRITY_RULES))


STRICT = replace(SPECS["orders"], ddl="o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DECIMAL(10,2), "
                                      "o_orderdate TIMESTAMP_NTZ, o_channel STRING")


@query("schema_refusals", """
    WITH found AS (
      SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
        ELSE lower(column_type) END AS f FROM (DESCRIBE orders)),
    expected(c, e) AS (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_totalprice', 'decimal(10,2)'),
      ('o_orderdate', 'timestamp_ntz'), ('o_channel', 'string'))
    SELECT coalesce(x.c, y.c) AS "column", e AS expected, f AS found FROM expected x FULL JOIN found y ON x.c = y.c
    WHERE e IS DISTINCT FROM f""")
def schema_refusals(d: Domain):
    # the orders as given against a stricter declaration: a column short, two too many, one of another type
    return validate.schema_report(d.raw("orders"), STRICT)
