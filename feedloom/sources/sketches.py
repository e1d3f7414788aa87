"""Sketches of every batch, stored beside the data and merged when asked: numbers over any set of batches without
reading their rows again.

    <path>/sketches/batch_id=<n>/*.parquet    one row per group of batch n: rows, a distinct and a quantile sketch
    <path>/commits/...                        written last, as for any dataset

A group's rows are counted exactly; distinct values come from a HyperLogLog sketch and quantiles from a KLL sketch. Both
are merged without loss: the merged sketch is as good as one over all rows, whatever the batches. A rerun of a batch
replaces its folder, so no row counts twice. A sketch's size does not grow with its rows.

Stated errors: a distinct count is within `DISTINCT_ERROR` of the true one (relative, three standard errors; small
counts are exact), a quantile's rank within `RANK_ERROR` of the rank asked for (absolute share of the group's rows, at
most half of what the sketch keeps apart).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from feedloom.sources.dataset import committed, read_or_none, write_commit

TABLE = "sketches"
LG_BUCKETS = 14  # 16,384 buckets: a standard error of 0.8 %
KEPT = 1_000  # items of a level of the quantile sketch
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_BUCKETS / 2)
RANK_ERROR = 0.01
SKETCH_DDL = "n BIGINT, kinds BINARY, spread BINARY"


def sketched(rows: DataFrame, by: Sequence[str], *, distinct: str, number: str) -> DataFrame:
    """One row per group: rows `n`, sketch `kinds` of the values of `distinct`, sketch `spread` of the whole numbers
    `number`. Nulls enter neither sketch but count as rows. No rows give no group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LG_BUCKETS).alias("kinds"),
        F.kll_sketch_agg_bigint(F.col(number).cast("bigint"), KEPT).alias("spread"))


def write_batch(spark: SparkSession, sketches: DataFrame, path: str, batch_id: int) -> None:
    """Store the sketches of a batch and commit it. Runs jobs; repeating it replaces the batch."""
    sketches.write.mode("overwrite").parquet(f"{path}/{TABLE}/batch_id={batch_id}")
    write_commit(spark, path, batch_id=batch_id, kind="sketch", counts={})


def merged(spark: SparkSession, path: str, by: str, *, batches: Sequence[int] | None = None) -> DataFrame:
    """One row per group over all committed batches, or those of `batches` that are committed. `by` is the group's DDL."""
    schema = StructType.fromDDL(f"{by}, {SKETCH_DDL}")
    keys = StructType.fromDDL(by).names
    found = read_or_none(spark, f"{path}/{TABLE}", StructType(list(schema)).add("batch_id", IntegerType()))
    if found is None:
        return spark.createDataFrame([], schema)
    visible = committed(spark, path)
    if batches is not None:
        visible = visible.where(F.col("batch_id").isin(list(batches)))
    return found.join(visible, "batch_id", "left_semi").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("kinds").alias("kinds"), F.kll_merge_agg_bigint("spread").alias("spread"))


def estimates(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The groups' numbers: `n`, `distinct_values` and one column per quantile; null where a group has no number."""
    keys = [c for c in sketches.columns if c not in ("n", "kinds", "spread")]
    some = F.kll_sketch_get_n_bigint("spread") > 0
    return sketches.select(
        *keys, "n", F.hll_sketch_estimate("kinds").alias("distinct_values"),
        *[F.when(some, F.kll_sketch_get_quantile_bigint("spread", F.lit(q))).alias(name) for name, q in quantiles.items()])


def beside_exact(rows: DataFrame, found: DataFrame, by: Sequence[str], *, distinct: str, number: str,
                 quantiles: dict[str, float]) -> DataFrame:
    """Exact numbers per group, and whether each estimate of `found` keeps its stated error: `distinct_values`,
    `distinct_within` and per quantile `<name>_within`."""
    kinds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("exact_n"), F.countDistinct(distinct).alias("exact"))
    # how often each number occurs, so that a rank is a sum over few rows
    histogram = rows.where(F.col(number).isNotNull()).groupBy(*by, F.col(number).alias("value")).agg(
        F.count(F.lit(1)).alias("times"))
    ranks = []
    for name, q in quantiles.items():
        below, upto = (F.sum(F.when(c, F.col("times")).otherwise(0)) / F.sum("times")
                       for c in (F.col("value") < F.col(name), F.col("value") <= F.col(name)))
        ranks.append(((below <= q + RANK_ERROR) & (upto >= q - RANK_ERROR)).alias(f"{name}_within"))
    kept = histogram.join(found, list(by)).groupBy(*by).agg(*ranks)
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.ceil(F.col("exact") * DISTINCT_ERROR)
    return kinds.join(found, list(by)).join(kept, list(by), "left").select(
        *by, F.col("exact_n").alias("n"), F.col("exact").alias("distinct_values"),
        (close & (F.col("n") == F.col("exact_n"))).alias("distinct_within"), *[f"{name}_within" for name in quantiles])
