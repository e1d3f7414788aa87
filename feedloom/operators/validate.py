"""Value rules of one table, checked in one scan, plus one grouped count per unique column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.schemas import TABLES, TableSpec

REPORT_DDL = "rule STRING, violations BIGINT"


def value_rules(spec: TableSpec) -> dict[str, Column]:
    """Rule name -> condition that is true for a broken row. A null breaks only the null rule."""
    broken: dict[str, Column] = {}
    for name in spec.columns:
        if name not in spec.nullable:
            broken[f"{name} is present"] = F.col(name).isNull()
    for name, pattern in spec.patterns.items():
        broken[f"{name} matches its pattern"] = ~F.col(name).rlike(pattern)
    for name, values in spec.members.items():
        broken[f"{name} is a known value"] = ~F.col(name).isin(values)
    for name, (low, high, exclusive) in spec.ranges.items():
        outside = F.lit(False)
        if low is not None:
            outside = outside | ((F.col(name) <= low) if exclusive else (F.col(name) < low))
        if high is not None:
            outside = outside | (F.col(name) > high)
        broken[f"{name} is in range"] = outside
    for name, least in spec.min_length.items():
        broken[f"{name} is long enough"] = F.length(name) < least
    for name, holds in spec.row_checks.items():
        broken[name] = ~F.expr(holds)
    return broken


def validate_values(df: DataFrame, spec: TableSpec, only: str | None = None) -> DataFrame:
    """(rule, violations) for every value rule, or those whose name contains `only`, in one aggregate."""
    rules = {name: c for name, c in value_rules(spec).items() if only is None or only in name}
    counts = df.agg(*[F.count_if(c).alias(str(i)) for i, c in enumerate(rules.values())])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(str(i)).alias("violations")) for i, name in enumerate(rules)])))


def validate_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rule, violations): rows that share their value of a unique column with another row."""
    def shared(column: str) -> DataFrame:
        groups = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.lit(f"{column} is unique").alias("rule"),
                          F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations"))
    return reduce(DataFrame.unionByName, [shared(c) for c in columns])


def schema_report(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(column, expected, found): columns that are missing, unknown or of another type. Empty when strict."""
    expected = {f.name: f.dataType.simpleString() for f in spec.schema}
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, expected.get(c), found.get(c)) for c in sorted(expected | found) if expected.get(c) != found.get(c)]
    return df.sparkSession.createDataFrame(rows, "column STRING, expected STRING, found STRING")


def validate_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(rule, violations) for every rule of one table."""
    report = validate_values(df, spec)
    return report.unionByName(validate_unique(df, list(spec.unique))) if spec.unique else report


def validate_dataset(tables: dict[str, DataFrame], specs: dict[str, TableSpec] = TABLES) -> DataFrame:
    """(table, rule, violations) over all tables given."""
    reports = [validate_table(df, specs[name]).select(F.lit(name).alias("table"), "rule", "violations")
               for name, df in tables.items()]
    return reduce(DataFrame.unionByName, reports)


class ValidationError(ValueError):
    """Raised with every broken rule."""


def check_schemas(tables: dict[str, DataFrame], specs: dict[str, TableSpec] = TABLES) -> None:
    """Raise if any table breaks its schema."""
    wrong = [f"{name}.{r.column}: expected {r.expected}, found {r.found}"
             for name, df in tables.items() for r in schema_report(df, specs[name]).collect()]
    if wrong:
        raise ValidationError("\n".join(wrong))


def check_tables(tables: dict[str, DataFrame], specs: dict[str, TableSpec] = TABLES) -> None:
    """Raise if any table breaks its schema or a rule. Runs jobs; only broken rules reach the driver."""
    check_schemas(tables, specs)
    wrong = [f"{r.table}: {r.rule} ({r.violations} rows)"
             for r in validate_dataset(tables, specs).where("violations > 0").collect()]
    if wrong:
        raise ValidationError("\n".join(wrong))
