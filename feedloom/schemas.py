"""Column names and types of every table, and the value rules each column must meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.fixed_values import CATEGORIES, CHOICES, COUNTRIES, EMAIL_PATTERN, FLAGS, FUEL_TYPES, GENDERS


def ident(prefix: str, digits: int) -> str:
    return rf"^{prefix}\d{{{digits}}}$"


@dataclass(frozen=True)
class TableSpec:
    """What one table must look like. `ranges` maps a column to (minimum, maximum, minimum is exclusive)."""

    ddl: str
    patterns: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    members: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    min_length: dict[str, int] = field(default_factory=dict)
    nullable: tuple[str, ...] = ()
    row_checks: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        """Needs a running session."""
        return StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.ddl.split(", ")]


LINE_TOTAL_CHECK = "abs(bround(quantity * unit_price, 2) - line_total) < 0.005"
ABOVE_ZERO, AT_LEAST_ONE = (0, None, True), (1, None, False)

TABLES: dict[str, TableSpec] = {
    "customers": TableSpec(
        "customer_id STRING, first_name STRING, last_name STRING, email STRING, phone STRING, "
        "street_address STRING, city STRING, postcode STRING, country STRING, locale STRING, gender STRING, "
        "date_of_birth DATE, signup_at TIMESTAMP_NTZ, batch_id INT",
        patterns={"customer_id": ident("C", 7), "email": EMAIL_PATTERN}, unique=("customer_id",),
        members={"country": COUNTRIES, "gender": GENDERS}, ranges={"batch_id": AT_LEAST_ONE}),
    "products": TableSpec(
        "product_id STRING, sku STRING, product_name STRING, category STRING, description STRING, "
        "list_price DOUBLE, fuel_type STRING, launched_on DATE",
        patterns={"product_id": ident("P", 3)}, unique=("product_id", "sku", "product_name"),
        members={"category": CATEGORIES, "fuel_type": FUEL_TYPES}, ranges={"list_price": ABOVE_ZERO},
        nullable=("fuel_type",)),
    "orders": TableSpec(
        "order_id STRING, customer_id STRING, ordered_at TIMESTAMP_NTZ, order_total DOUBLE, batch_id INT",
        patterns={"order_id": ident("O", 9), "customer_id": ident("C", 7)}, unique=("order_id",),
        ranges={"order_total": ABOVE_ZERO, "batch_id": AT_LEAST_ONE}),
    "order_lines": TableSpec(
        "order_line_id STRING, order_id STRING, product_id STRING, quantity INT, unit_price DOUBLE, "
        "line_total DOUBLE, batch_id INT",
        patterns={"order_line_id": ident("L", 10), "order_id": ident("O", 9), "product_id": ident("P", 3)},
        unique=("order_line_id",),
        ranges={"quantity": AT_LEAST_ONE, "unit_price": ABOVE_ZERO, "line_total": ABOVE_ZERO,
                "batch_id": AT_LEAST_ONE},
        row_checks={"line_total_is_quantity_times_price": LINE_TOTAL_CHECK}),
    "reviews": TableSpec(
        "review_id STRING, customer_id STRING, product_id STRING, order_line_id STRING, "
        "reviewed_at TIMESTAMP_NTZ, rating TINYINT, batch_id INT",
        patterns={"review_id": ident("R", 10), "customer_id": ident("C", 7), "product_id": ident("P", 3),
                  "order_line_id": ident("L", 10)},
        unique=("review_id", "order_line_id"), ranges={"rating": (1, 5, False), "batch_id": AT_LEAST_ONE}),
    "review_texts": TableSpec(
        "review_id STRING, prompt_hash STRING, review_text STRING, language STRING, model STRING, "
        "generated_at TIMESTAMP_NTZ",
        patterns={"review_id": ident("R", 10)}, min_length={"review_text": 1}),
    "review_truth": TableSpec(
        "review_id STRING, satisfaction DOUBLE, aspect STRING, language STRING",
        patterns={"review_id": ident("R", 10)}, unique=("review_id",), ranges={"satisfaction": (0.0, 1.0, False)}),
}

KEY = ["review_key", "sentence_index"]

ANSWERS_DDL = ", ".join(
    ["review_key STRING", "sentence_index INT", "frustration DOUBLE", "frustration_confidence DOUBLE"]
    + [f"{c} STRING" for c in CHOICES]
    + [f"{c}_confidence DOUBLE" for c in CHOICES]
    + [f"{f} DOUBLE" for f in FLAGS]
    + ["products_mentioned ARRAY<STRING>", "answers_json STRING", "model STRING", "question_set_version STRING",
       "input_tokens BIGINT", "output_tokens BIGINT", "latency_ms BIGINT", "error STRING"])

RAW_ANSWERS_DDL = ("review_key STRING, sentence_index INT, answers_json STRING, model STRING, "
                   "input_tokens BIGINT, output_tokens BIGINT, latency_ms BIGINT, error STRING")

VARIANTS_DDL = RAW_ANSWERS_DDL.replace("answers_json STRING", "answers VARIANT") + ", question_set_version STRING"

TEXT_DDL = TABLES["review_texts"].ddl

COMMITS_DDL = ("batch_id INT, kind STRING, created_at TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ, settings_hash STRING, "
               "writer STRING, counts MAP<STRING, BIGINT>")


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns in the declared order, cast to the declared types; missing ones become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(ddl)
    ])

