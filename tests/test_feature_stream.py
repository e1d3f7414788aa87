"""Features from a stream beside the batch features, whatever the order of arrival."""

import itertools
from datetime import date, datetime, timedelta

import pytest

from feedloom.operators.point_in_time import review_features
from feedloom.streaming.feature_stream import EVENT_DDL, events_of, feature_stream, finished_features, late_events

START = datetime(2020, 1, 1)


def day(n, **more):
    return START + timedelta(days=n, **more)


ORDERS = [("o1", "c1", day(0), 10.25), ("o2", "c1", day(5), 0.5), ("o3", "c2", day(5), None), ("o4", "c1", day(9), 7.0),
          ("o5", "c1", day(9), 7.0), ("o6", None, day(1), 1.0), ("o7", "c2", None, 1.0)]
REVIEWS = [("r1", "c1", day(5)), ("r2", "c1", day(9, microseconds=1)), ("r3", "c1", day(9)), ("r4", "c2", day(2)),
           ("r5", "c3", day(6)), ("r5", "c3", day(6)), ("r6", None, day(3))]
PEOPLE = [(c, day(-30), date(1980, 5, 1), "female", "DE", "extra") for c in ("c1", "c2", "c3")]


def tables(spark):
    return (spark.createDataFrame(ORDERS, "order_id string, customer_id string, ordered_at timestamp_ntz, order_total double"),
            spark.createDataFrame(REVIEWS, "review_id string, customer_id string, reviewed_at timestamp_ntz"),
            spark.createDataFrame(PEOPLE, "customer_id string, signup_at timestamp_ntz, date_of_birth date, gender string, "
                                          "country string, order_count string"))


def tick(spark, n):
    return spark.createDataFrame([("order", "tick", "t", day(n), 0)], EVENT_DDL.format(key="STRING"))


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_equals_the_batch_in_any_order(spark, tmp_path, order):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    orders, reviews, people = tables(spark)
    rows = events_of(orders, reviews).collect()
    for part in order:
        spark.createDataFrame(rows[part::3], EVENT_DDL.format(key="STRING")).coalesce(1).write.mode("append").parquet(source)
        feature_stream(spark, source, sink, checkpoint, delay="10 days").awaitTermination()
    tick(spark, 500).coalesce(1).write.mode("append").parquet(source)
    feature_stream(spark, source, sink, checkpoint, delay="10 days").awaitTermination()
    batch = review_features(reviews.where("customer_id IS NOT NULL"), people, orders)
    assert sorted(map(str, finished_features(spark, sink, people).collect())) == sorted(map(str, batch.collect()))


def test_late_events_are_counted_as_late_and_counted_nowhere(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    orders, reviews, people = tables(spark)
    first, late = orders.where("order_id != 'o1'"), orders.where("order_id = 'o1'")
    events_of(first, reviews).coalesce(1).write.parquet(source)
    tick(spark, 30).coalesce(1).write.mode("append").parquet(source)
    feature_stream(spark, source, sink, checkpoint, delay="10 days").awaitTermination()
    old = reviews.where("review_id = 'r4'")
    events_of(late, old).coalesce(1).write.mode("append").parquet(source)
    again = feature_stream(spark, source, sink, checkpoint, delay="10 days")
    again.awaitTermination()
    batch = review_features(reviews.where("customer_id IS NOT NULL"), people, first)
    assert sorted(map(str, finished_features(spark, sink, people).collect())) == sorted(map(str, batch.collect()))
    assert late_events(again) == 2


@pytest.mark.parametrize("buckets", [1, 2])
def test_customers_share_states(spark, tmp_path, buckets):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    orders, reviews, people = tables(spark)
    for part in (events_of(orders, reviews), tick(spark, 500)):
        part.coalesce(1).write.mode("append").parquet(source)
        run = feature_stream(spark, source, sink, checkpoint, delay="10 days", buckets=buckets)
        run.awaitTermination()
    batch = review_features(reviews.where("customer_id IS NOT NULL"), people, orders)
    assert sorted(map(str, finished_features(spark, sink, people).collect())) == sorted(map(str, batch.collect()))
    assert run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= buckets


def test_nothing_arrives(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([], EVENT_DDL.format(key="STRING")).write.parquet(source)
    feature_stream(spark, source, sink, checkpoint).awaitTermination()
    assert finished_features(spark, sink, tables(spark)[2]).count() == 0
