"""Merged roll-ups beside one roll-up over everything, after every batch."""

import random

from pyspark.sql import functions as F

from feedloom.operators.insights import problems_by_product
from feedloom.sources import rollups

DDL = "review_id STRING, product_name STRING, problem_category STRING, frustration DOUBLE, note STRING"


def rows(seed, n):
    pick = random.Random(seed)
    return [(f"r{pick.randrange(9)}", f"p{pick.randrange(3)}", pick.choice(["safety", "other", "none", None]),
             pick.choice([None, 0.125, 1.0, 2.35, 3.3]), "x") for _ in range(n)]


def same(spark, path, everything):
    full = problems_by_product(spark.createDataFrame(everything, DDL))
    assert sorted(map(str, rollups.problems(spark, path).collect())) == sorted(map(str, full.collect()))


def test_equal_after_every_batch(spark, tmp_path):
    path, now = str(tmp_path), []
    for batch in range(1, 5):
        gone, come = now[:4 * (batch - 1)], rows(batch, 12)
        changes = rollups.changed(spark.createDataFrame(gone, DDL) if gone else None, spark.createDataFrame(come, DDL))
        now = now[len(gone):] + come
        rollups.merge_problems(spark, changes, path, batch)
        same(spark, path, now)
    rollups.compact(spark, path, "STRING")
    same(spark, path, now)
    rollups.merge_problems(spark, rollups.changed(spark.createDataFrame(now, DDL), None), path, 6)
    same(spark, path, [])


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path, first, second = str(tmp_path), rows(1, 10), rows(2, 10)
    rollups.merge_problems(spark, rollups.changed(None, spark.createDataFrame(first, DDL)), path, 1)
    for _ in range(2):
        rollups.merge_problems(spark, rollups.changed(None, spark.createDataFrame(second, DDL)), path, 2)
    same(spark, path, first + second)


def test_only_touched_keys_are_written_and_empty_batches_do_nothing(spark, tmp_path):
    path, one = str(tmp_path), [("r1", "p1", "safety", 1.0, "x"), ("r2", "p2", "safety", 2.0, "x")]
    rollups.merge_problems(spark, rollups.changed(None, spark.createDataFrame(one, DDL)), path, 1)
    more = [("r3", "p2", "safety", 2.0, "x")]
    assert rollups.merge_problems(spark, rollups.changed(None, spark.createDataFrame(more, DDL)), path, 2) == {
        "pairs": 1, "problems": 1}
    nothing = rollups.changed(None, spark.createDataFrame([], DDL))
    assert rollups.merge_problems(spark, nothing, path, 3) == {"pairs": 0, "problems": 0}
    same(spark, path, one + more)


def test_an_uncommitted_batch_is_not_read(spark, tmp_path):
    path, first = str(tmp_path), rows(1, 10)
    rollups.merge_problems(spark, rollups.changed(None, spark.createDataFrame(first, DDL)), path, 1)
    left = spark.createDataFrame([("p0", "safety", 9, 9, 9)], "product_name STRING, problem_category STRING, sentences BIGINT, "
                                 "rated BIGINT, reviews BIGINT").withColumn("frustration", F.lit(1).cast("decimal(28,6)"))
    rollups.upsert(left, path, "problems", 2)
    same(spark, path, first)
