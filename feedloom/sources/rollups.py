"""Roll-ups kept up to date batch by batch: only the keys that a batch touches are merged and written.

    <path>/<table>/batch_id=<n>/*.parquet     the new state of every key that batch n touched
    <path>/commits/...                        written last, as for any dataset

The state of a key is its row of the last committed batch that touched it, so nothing older is rewritten, a rerun of a
batch replaces what an interrupted run left, and it never reads its own rows. `compact` writes the current state as one
batch, which readers then start from.

Changes are signed: +1 for a classified sentence that counts from now on, -1 for one that no longer does. A sentence that
failed and is answered later is the change +1 of its answer; an answer that is revised is -1 of the old and +1 of the new.
Counts and sums are added; the number of distinct reviews changes where a (product, problem, review) begins or ceases to
hold a sentence. Amounts are added as decimals, so the merged state equals one roll-up over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from feedloom.operators.insights import cents
from feedloom.sources.dataset import committed, last_batch, read_or_none, write_commit

PRODUCT = ["product_name", "problem_category"]
PAIR = [*PRODUCT, "review_id"]
SUMS = {"sentences": "BIGINT", "frustration": "DECIMAL(28,6)", "rated": "BIGINT"}
MERGED = ", ".join(f"{c} {t}" for c, t in SUMS.items())


def latest(spark: SparkSession, path: str, table: str, ddl: str, keys: list[str], *, before: int | None = None,
           only: DataFrame | None = None) -> DataFrame:
    """One row per key, that of the last committed batch (before one), of all keys or those in `only`."""
    schema = StructType.fromDDL(ddl)
    found = read_or_none(spark, f"{path}/{table}", StructType(list(schema)).add("batch_id", IntegerType()))
    if found is None:
        return spark.createDataFrame([], schema)
    batches = committed(spark, path)
    if before is not None:
        batches = batches.where(F.col("batch_id") < before)
    rows = found.join(batches, "batch_id", "left_semi")
    if only is not None:
        rows = rows.join(only.select(*keys), keys, "left_semi")
    others = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("last")) \
        .select(*[c if c in keys else f"last.{c}" for c in schema.names])


def upsert(rows: DataFrame, path: str, table: str, batch_id: int) -> int:
    """Write the new state of the touched keys into the batch's folder; how many. Runs a job."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{table}/batch_id={batch_id}")
    return seen.get["n"]


def _added(changes: DataFrame, old: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Old state plus changes, per key of `changes`; the old sums stay beside as `old_<column>`."""
    before = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in sums])
    joined = changes.join(before, keys, "left")
    return joined.select(*keys, *[F.coalesce(F.col(f"old_{c}"), F.lit(0)).alias(f"old_{c}") for c in sums],
                         *[F.col(c).alias(f"new_{c}") for c in sums])


def _kinds(extra: str = "") -> str:
    return MERGED + extra


PAIR_DDL = "product_name STRING, problem_category STRING, review_id {key}, " + _kinds()
PROBLEM_DDL = "product_name STRING, problem_category STRING, " + _kinds(", reviews BIGINT")


def merge_problems(spark: SparkSession, changes: DataFrame, path: str, batch_id: int) -> dict[str, int]:
    """Merge signed changes (classified sentences with a column `change`) into the problems of each product; rows
    written. Runs jobs. Repeating a batch gives the same state."""
    pair_ddl = PAIR_DDL.format(key=dict(changes.dtypes)["review_id"])
    amount = F.col("frustration").cast("decimal(18,6)")
    delta = changes.where("problem_category != 'none'").groupBy(*PAIR).agg(
        F.sum("change").cast("bigint").alias("sentences"),
        F.coalesce(F.sum(amount * F.col("change")), F.lit(0)).cast("decimal(28,6)").alias("frustration"),
        F.coalesce(F.sum(F.when(amount.isNotNull(), F.col("change"))), F.lit(0)).cast("bigint").alias("rated"))
    sums = list(SUMS)
    known = latest(spark, path, "pairs", pair_ddl, PAIR, before=batch_id, only=delta)
    moved = _added(delta, known, PAIR, sums)
    state = moved.select(*PAIR, *[(F.col(f"old_{c}") + F.col(f"new_{c}")).cast(SUMS[c]).alias(c) for c in sums])
    counts = {"pairs": upsert(state, path, "pairs", batch_id)}

    # from the pairs just written and those before: what changed per product and problem
    written = spark.read.schema(pair_ddl).parquet(f"{path}/pairs/batch_id={batch_id}")
    old = latest(spark, path, "pairs", pair_ddl, PAIR, before=batch_id, only=written)
    both = _added(written, old, PAIR, sums)
    holds = {side: (F.col(f"{side}_sentences") > 0).cast("int") for side in ("old", "new")}
    per_product = both.groupBy(*PRODUCT).agg(
        *[F.sum(F.col(f"new_{c}") - F.col(f"old_{c}")).cast(SUMS[c]).alias(c) for c in sums],
        F.sum(holds["new"] - holds["old"]).alias("reviews"))
    before = latest(spark, path, "problems", PROBLEM_DDL, PRODUCT, before=batch_id, only=per_product)
    columns = [*sums, "reviews"]
    merged = _added(per_product, before, PRODUCT, columns).select(
        *PRODUCT, *[(F.col(f"old_{c}") + F.col(f"new_{c}")).cast(SUMS.get(c, "BIGINT")).alias(c) for c in columns])
    counts["problems"] = upsert(merged, path, "problems", batch_id)
    write_commit(spark, path, batch_id=batch_id, kind="rollup", counts=counts)
    return counts


def problems(spark: SparkSession, path: str) -> DataFrame:
    """`insights.problems_by_product` over everything merged so far."""
    state = latest(spark, path, "problems", PROBLEM_DDL, PRODUCT).where("sentences > 0")
    return state.select(*PRODUCT, "sentences", "reviews",
                        cents(F.try_divide(F.col("frustration").cast("double"), F.col("rated"))).alias("mean_frustration"))


def changed(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Signed changes from rows that no longer count and rows that do."""
    columns = [*PAIR, "frustration"]
    parts = [df.select(*columns, F.lit(sign).alias("change")) for df, sign in ((old, -1), (new, 1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, path: str, key_type: str) -> int:
    """The current state of both tables as a batch of its own, after the last one; its number. Runs jobs."""
    last = last_batch(spark, path)
    batch = (0 if last is None else last) + 1
    counts = {"pairs": upsert(latest(spark, path, "pairs", PAIR_DDL.format(key=key_type), PAIR, before=batch)
                              .where("sentences != 0"), path, "pairs", batch),
              "problems": upsert(latest(spark, path, "problems", PROBLEM_DDL, PRODUCT, before=batch)
                                 .where("sentences != 0"), path, "problems", batch)}
    write_commit(spark, path, batch_id=batch, kind="compact", counts=counts)
    return batch
