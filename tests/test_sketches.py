"""Sketches merged over batches beside exact numbers."""

import random

from pyspark.sql import functions as F

from feedloom.sources import sketches

BY = "shop STRING"
QUANTILES = {"p50": 0.5, "p95": 0.95}
DDL = "shop STRING, buyer STRING, ms INT, ms_n STRING"


def numbered(spark, start, stop, shop="a"):
    return spark.range(start, stop).select(
        F.lit(shop).alias("shop"), F.concat(F.lit("b"), (F.col("id") % 40_000).cast("string")).alias("buyer"),
        (F.col("id") * 7919 % 50_021).cast("int").alias("ms"), F.lit("x").alias("ms_n"))


def stored(spark, rows, path, batch):
    sketches.write_batch(spark, sketches.sketched(rows, ["shop"], distinct="buyer", number="ms"), path, batch)


def judged(spark, rows, path, **only):
    found = sketches.estimates(sketches.merged(spark, path, BY, **only), QUANTILES)
    return sketches.beside_exact(rows, found, ["shop"], distinct="buyer", number="ms", quantiles=QUANTILES).collect()


def test_errors_are_kept_over_all_batches(spark, tmp_path):
    path = str(tmp_path)
    whole = numbered(spark, 0, 150_000).unionByName(numbered(spark, 0, 5_000, "b"))
    borders = [0, 100, 60_000, 150_000]
    for batch, (low, high) in enumerate(zip(borders, borders[1:], strict=False), 1):
        part = numbered(spark, low, high)
        stored(spark, part.unionByName(numbered(spark, 0, 5_000, "b")) if batch == 2 else part, path, batch)
    found = {r.shop: r for r in judged(spark, whole, path)}
    assert (found["a"].n, found["a"].distinct_values, found["b"].n) == (150_000, 40_000, 5_000)
    assert all(r.distinct_within and r.p50_within and r.p95_within for r in found.values())


def test_a_wrong_sketch_is_noticed(spark, tmp_path):
    stored(spark, numbered(spark, 0, 20_000), str(tmp_path), 1)
    (row,) = judged(spark, numbered(spark, 0, 40_000), str(tmp_path))
    assert not row.distinct_within
    high = numbered(spark, 0, 20_000).withColumn("ms", F.col("ms") + 25_000)
    (row,) = judged(spark, high, str(tmp_path))
    assert row.distinct_within and not row.p50_within


def test_small_groups_are_exact(spark, tmp_path):
    pick = random.Random(5)
    rows = [(pick.choice(["a", "b", None]), f"b{pick.randrange(20)}", pick.randrange(30), "x") for _ in range(60)]
    df = spark.createDataFrame(rows, DDL)
    stored(spark, df.where("ms < 10"), str(tmp_path), 1)
    stored(spark, df.where("ms >= 10"), str(tmp_path), 2)
    found = {r.shop: r for r in sketches.estimates(sketches.merged(spark, str(tmp_path), BY), QUANTILES).collect()}
    for shop in ("a", "b", None):
        mine = [r for r in rows if r[0] == shop]
        assert (found[shop].n, found[shop].distinct_values) == (len(mine), len({r[1] for r in mine}))


def test_rerun_uncommitted_and_chosen_batches(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        stored(spark, numbered(spark, 0, 1_000), path, 1)
    stored(spark, numbered(spark, 1_000, 3_000), path, 2)
    left = sketches.sketched(numbered(spark, 0, 9), ["shop"], distinct="buyer", number="ms")
    left.write.parquet(f"{path}/{sketches.TABLE}/batch_id=3")
    assert sketches.merged(spark, path, BY).first().n == 3_000
    assert sketches.merged(spark, path, BY, batches=[2, 3]).first().n == 2_000
    assert sketches.merged(spark, path, BY, batches=[]).count() == 0


def test_nulls_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    assert sketches.merged(spark, path, BY).count() == 0
    stored(spark, spark.createDataFrame([], DDL), path, 1)
    assert sketches.merged(spark, path, BY).count() == 0
    stored(spark, spark.createDataFrame([("a", None, None, "x"), ("a", None, None, "x")], DDL), path, 2)
    stored(spark, spark.createDataFrame([("c", "b1", None, "x"), ("c", None, 4, "x")], DDL), path, 3)
    found = {r.shop: r for r in sketches.estimates(sketches.merged(spark, path, BY), QUANTILES).collect()}
    assert (found["a"].n, found["a"].distinct_values, found["a"].p50) == (2, 0, None)
    assert (found["c"].n, found["c"].distinct_values, found["c"].p50, found["c"].p95) == (2, 1, 4, 4)
