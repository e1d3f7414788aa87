"""Features as at a review: only strictly earlier events, ties together, nothing from the future."""

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from feedloom.operators.point_in_time import leakage_check, point_in_time, review_features, running_totals

ORDERS = "order_id STRING, customer_id STRING, ordered_at TIMESTAMP_NTZ, order_total DOUBLE"
REVIEWS = "review_id STRING, customer_id STRING, reviewed_at TIMESTAMP_NTZ"
WHO = "C0000001"


def day(month, dom, hour=0):
    return datetime(2025, month, dom, hour)


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [(WHO, datetime(2025, 1, 1), date(1980, 6, 1), "female", "Canada")],
        "customer_id STRING, signup_at TIMESTAMP_NTZ, date_of_birth DATE, gender STRING, country STRING")


def features(spark, customers, orders, reviews):
    o = spark.createDataFrame([(f"O{i}", WHO, t, v) for i, (t, v) in enumerate(orders)], ORDERS)
    r = spark.createDataFrame([(f"R{i}", WHO, t) for i, t in enumerate(reviews)], REVIEWS)
    return review_features(r, customers, o).orderBy("review_id").collect()


@pytest.mark.parametrize("orders, review, revenue, count, since", [
    ([(day(3, 1, 9), 100.0)], day(3, 1, 18), 100.0, 1, 9 / 24),
    ([(day(2, 1), 50.0), (day(4, 1), 5000.0)], day(3, 1), 50.0, 1, 28.0),
    ([(day(2, 1), 50.0), (day(3, 1, 12), 70.0)], day(3, 1, 12), 50.0, 1, 28.5),
    ([(day(9, 1), 10.0)], day(3, 1), 0.0, 0, None),
])
def test_only_strictly_earlier_orders_count(spark, customers, orders, review, revenue, count, since):
    row = features(spark, customers, orders, [review])[0]
    assert (row.lifetime_revenue, row.order_count) == (revenue, count)
    assert row.days_since_last_order == (None if since is None else pytest.approx(since))


def test_each_review_sees_its_own_past(spark, customers):
    rows = features(spark, customers, [(day(2, 1), 40.0), (day(5, 1), 60.0), (day(9, 1), 900.0)],
                    [day(2, 10), day(6, 1)])
    assert [r.lifetime_revenue for r in rows] == [40.0, 100.0]
    assert [r.order_count for r in rows] == [1, 2]
    assert [r.previous_reviews for r in rows] == [0, 1]


def test_tenure_and_age(spark, customers):
    row = features(spark, customers, [(day(1, 5), 10.0)], [day(7, 1)])[0]
    assert (row.tenure_days, row.age) == (181.0, 45)


def test_simultaneous_events_are_collapsed(spark):
    events = spark.createDataFrame([("a", day(1, 1), 1.0), ("a", day(1, 1), 2.0), ("a", day(1, 2), 4.0)],
                                   "k STRING, t TIMESTAMP_NTZ, v DOUBLE")
    left = spark.createDataFrame([("a", day(1, 3)), ("b", day(1, 3)), (None, day(1, 3))], "k STRING, at TIMESTAMP_NTZ")
    got = {r.k: (r.total, r.n, r.latest) for r in point_in_time(
        left, events, by="k", at="at", event_time="t", sums={"total": "v"}, count="n", last_event="latest").collect()}
    assert got == {"a": (7.0, 3, day(1, 2)), "b": (0.0, 0, None), None: (0.0, 0, None)}
    totals = running_totals(events, by="k", at="t", sums={"total": "v"}, count="n").orderBy("t").collect()
    assert [(r.total, r.n) for r in totals] == [(3.0, 2), (7.0, 3)]


def random_tables(spark, seed=5, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    # one customer holds a third of everything, and moments are coarse so that many coincide
    who = lambda i: "hot" if i % 3 == 0 else f"c{rng.randrange(30)}"
    when = lambda: start + timedelta(hours=6 * rng.randrange(400))
    orders = [(f"O{i}", who(i), when(), float(rng.randrange(1, 100))) for i in range(n)]
    reviews = [(f"R{i}", who(i), when()) for i in range(n // 2)]
    people = [(c, start, date(1980, 1, 1), "male", "Japan") for c in ["hot", *[f"c{i}" for i in range(30)]]]
    return (spark.createDataFrame(orders, ORDERS), spark.createDataFrame(reviews, REVIEWS),
            spark.createDataFrame(people, "customer_id STRING, signup_at TIMESTAMP_NTZ, date_of_birth DATE, "
                                          "gender STRING, country STRING"), orders, reviews)


@pytest.mark.parametrize("seconds, busy", [(3_600, 0), (86_400, 0), (86_400, 50), (10**9, 0), (86_400, 10**6)])
def test_equals_brute_force_under_any_slicing(spark, seconds, busy):
    orders, reviews, people, order_rows, review_rows = random_tables(spark)
    got = {r.review_id: r for r in review_features(reviews, people, orders, slice_seconds=seconds, busy_rows=busy).collect()}
    assert len(got) == len(review_rows)
    for rid, who, at in review_rows:
        past = [(t, v) for _, c, t, v in order_rows if c == who and t < at]
        assert got[rid].order_count == len(past)
        assert got[rid].lifetime_revenue == pytest.approx(sum(v for _, v in past))
        assert got[rid].previous_reviews == sum(1 for _, c, t in review_rows if c == who and t < at)
        latest = max((t for t, _ in past), default=None)
        expected = None if latest is None else (at - latest).total_seconds() / 86_400
        assert got[rid].days_since_last_order == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("partitions", [1, 50])
def test_partition_count_does_not_matter(spark, partitions):
    orders, reviews, people, *_ = random_tables(spark)
    usual = sorted(map(tuple, review_features(reviews, people, orders).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert sorted(map(tuple, review_features(reviews, people, orders).collect())) == usual
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_future_moves_nothing(spark):
    orders, reviews, people, *_ = random_tables(spark)
    latest = reviews.groupBy("customer_id").agg(F.max("reviewed_at").alias("t"))
    later = F.expr("t + INTERVAL 1 SECOND")
    more_orders = latest.select("customer_id", later.alias("ordered_at"), F.lit(1e6).alias("order_total"))
    more_reviews = latest.select(F.lit("new").alias("review_id"), "customer_id", later.alias("reviewed_at"))
    row = leakage_check(reviews, people, orders, more_orders, more_reviews).first()
    assert (row.reviews, row.changed) == (reviews.count(), 0)
    # the check does notice a past event
    early = more_orders.withColumn("ordered_at", F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz"))
    assert leakage_check(reviews, people, orders, early, more_reviews).first().changed == reviews.count()


def test_plan_compares_no_pairs(spark):
    orders, reviews, people, *_ = random_tables(spark)
    plan = plan_of(review_features(reviews, people, orders))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
