"""Tables on shared storage: single tables, batches, and the commits that make batches visible.

    <path>/<table>/batch_id=<n>/*.parquet     one folder per table and batch
    <path>/<table>.parquet                    or a whole table at once
    <path>/commits/batch_id=<n>/*.parquet     one row per committed batch, written last

A batch folder is overwritten as a whole, so a rerun replaces what an interrupted run left behind, and
readers only see batches a commit names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from feedloom.operators.integrity import check_integrity, integrity_report
from feedloom.operators.validate import check_schemas, check_tables, validate_dataset, value_rules
from feedloom.schemas import COMMITS_DDL, TABLES, TableSpec, conform

COMMITS = "commits"
BROKEN, BROKEN_DDL = "broken_rules", "rule STRING, violations BIGINT, sample STRING"


def read_or_none(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A Parquet table under a declared schema, or None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_catalogue(spark: SparkSession, path: str, spec: TableSpec = TABLES["products"]) -> DataFrame:
    """The product list from a CSV file with a header; columns by name, types and dates as declared."""
    header = spark.read.option("header", True).csv(path)
    return conform(header, spec.ddl)


CORRUPT = "__corrupt"


def checked_catalogue(spark: SparkSession, path: str, spec: TableSpec = TABLES["products"]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) from a CSV file with a header: typed rows that keep every value rule, and (line, reasons) of
    all others.

    Columns are found by name, further ones are ignored and missing ones are null. A line of too few or too many fields,
    a field that is not of its column's type and a broken rule of `spec` are reasons; a line is listed once with all its
    reasons. Uniqueness is a rule across rows and is checked on what is accepted, by `validate_unique`. Empty lines are
    no rows; a file with a header only gives two empty tables. The file is read in parallel and once per table asked for.
    """
    names = spark.read.option("header", True).csv(path).columns
    text = StructType([StructField(c, StringType()) for c in [*names, CORRUPT]])
    # every column is read, or Spark would not look at fields that are not asked for
    lines = spark.read.schema(text).option("header", True).option("columnNameOfCorruptRecord", CORRUPT) \
        .option("columnPruning", False).csv(path)
    fields = list(spec.schema)
    raw = {f.name: F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast("string") for f in fields}
    typed = lines.select(CORRUPT, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__line"), *[
        column.alias(f"__raw_{name}") for name, column in raw.items()], *[
        raw[f.name].try_cast(f.dataType).alias(f.name) for f in fields])
    whole = F.col(CORRUPT).isNull()
    reasons = [F.when(~whole, "the number of fields differs from the header's")]
    reasons += [F.when(whole & F.col(f"__raw_{f.name}").isNotNull() & F.col(f.name).isNull(),
                       f"{f.name} is not {f.dataType.simpleString()}") for f in fields]
    misread = {f"{f.name} is present": F.col(f"__raw_{f.name}").isNull() for f in fields}  # not both reasons for one field
    reasons += [F.when(whole & broken & misread.get(rule, F.lit(True)), rule) for rule, broken in value_rules(spec).items()]
    judged = typed.withColumn("reasons", F.array_compact(F.array(*reasons)))
    accepted = judged.where(F.size("reasons") == 0).select(*[f.name for f in fields])
    rejected = judged.where(F.size("reasons") > 0).select(F.coalesce(CORRUPT, "__line").alias("line"), "reasons")
    return accepted, rejected


# --- commits ---------------------------------------------------------------------------------

def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed batch."""
    schema = StructType.fromDDL(COMMITS_DDL)
    found = read_or_none(spark, f"{path}/{COMMITS}", schema)
    return spark.createDataFrame([], schema) if found is None else found


def write_commit(spark: SparkSession, path: str, *, batch_id: int, kind: str, counts: Mapping[str, int],
                 as_of: datetime | None = None, settings_hash: str | None = None, writer: str | None = None) -> None:
    """Make a batch visible. Runs a job; repeating it replaces the same row."""
    row = (batch_id, kind, datetime.now(UTC).replace(tzinfo=None), as_of, settings_hash, writer, dict(counts))
    spark.createDataFrame([row], COMMITS_DDL).drop("batch_id").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/{COMMITS}/batch_id={batch_id}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id) of every committed batch, to join with."""
    return read_commits(spark, path).select(F.col("batch_id").cast("int").alias("batch_id")).distinct()


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The largest committed batch id."""
    return read_commits(spark, path).agg(F.max("batch_id")).first()[0]


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """The committed batch ids in order, for a look at the history; readers join with `committed`."""
    return [r.batch_id for r in read_commits(spark, path).select("batch_id").orderBy("batch_id").collect()]


def batch_status(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, kind, created_at, as_of, writer, table, rows): the history of a dataset."""
    return read_commits(spark, path).select("batch_id", "kind", "created_at", "as_of", "writer",
                                            F.explode("counts").alias("table", "rows"))


# --- tables ----------------------------------------------------------------------------------

def read_dataset(spark: SparkSession, path: str, *, batches: Iterable[int] | None = None,
                 specs: Mapping[str, TableSpec] = TABLES) -> dict[str, DataFrame]:
    """Every table present, lazily; absent tables are absent from the result.

    Batches are limited to `batches` or else to the committed ones, by a semi join on the partition column,
    which prunes other batches' files at run time.
    """
    visible = committed(spark, path) if batches is None else spark.createDataFrame(
        [(int(b),) for b in batches], "batch_id INT")
    tables = {}
    for name, spec in specs.items():
        whole = read_or_none(spark, f"{path}/{name}.parquet", spec.schema)
        layered = StructType([f for f in spec.schema if f.name != "batch_id"]).add("batch_id", IntegerType())
        parts = read_or_none(spark, f"{path}/{name}", layered)
        found = [] if whole is None else [whole]
        if parts is not None:
            found.append(conform(parts.join(visible, "batch_id", "left_semi"), spec.ddl))
        if found:
            tables[name] = reduce(DataFrame.unionByName, found)
    return tables


def write_dataset(tables: Mapping[str, DataFrame], path: str, *, specs: Mapping[str, TableSpec] = TABLES,
                  rules: list[str] | None = None, refuse: bool = True) -> None:
    """Check every table and the rules across them, or those of `rules`, then write each whole. Runs jobs.

    A broken rule refuses them all. Without `refuse` it is stored beside them instead, see `broken_rules`: for tables that
    come as they are. Columns that are missing or of another type refuse them always, as they could not be read back.
    """
    unknown = set(tables) - set(specs)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if refuse:
        check_tables(dict(tables), dict(specs))
        check_integrity(dict(tables), rules=rules)
    else:
        check_schemas(dict(tables), dict(specs))
        within = validate_dataset(dict(tables), dict(specs)).select(
            F.concat_ws(": ", "table", "rule").alias("rule"), "violations", F.lit("").alias("sample"))
        across = integrity_report(dict(tables), rules=rules)
        within.unionByName(across).where("violations > 0").write.mode("overwrite").parquet(f"{path}/{BROKEN}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def broken_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, violations, sample) of what was broken when a dataset was written without refusing; sample keys of rules
    across tables."""
    return spark.read.schema(BROKEN_DDL).parquet(f"{path}/{BROKEN}")


def write_batch(tables: Mapping[str, DataFrame], batch_id: int, path: str, *,
                specs: Mapping[str, TableSpec] = TABLES) -> dict[str, int]:
    """Write one folder per table for this batch and count its rows while writing. Runs jobs.

    Tables this batch does not have are emptied in its folder if an interrupted run left rows there.
    """
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        rows = df.drop("batch_id").observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        counts[name] = seen.get["n"]
    for name in set(specs) - set(tables):
        spark = next(iter(tables.values())).sparkSession
        body = StructType([f for f in specs[name].schema if f.name != "batch_id"])
        left_behind = f"{path}/{name}/batch_id={batch_id}"
        if read_or_none(spark, left_behind, body) is not None:
            spark.createDataFrame([], body).write.mode("overwrite").parquet(left_behind)
    return counts


def settings_hash(settings: Mapping) -> str:
    """Identifies the settings a dataset was started with."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]
