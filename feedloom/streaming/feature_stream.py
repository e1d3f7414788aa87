"""Point-in-time features of reviews as orders and reviews arrive, in any order within the watermark's delay.

Per customer the state holds totals over everything before the watermark and the events from it on. A review leaves the
stream with its features once the watermark has passed it: then every earlier event has arrived or is late. An event not
after the watermark is late: Spark drops it before the state sees it, and `late_events` counts it. So the rows that leave
equal `review_features` over all events that were not late, whatever the order of arrival.

Events without a customer or a time are left out, as no moment can be given to them. Repeated rows are events each. The
state of a customer is four numbers and the events of the delay; an event-time timer wakes the bucket of customers it is
kept in, so a customer who is never heard of again still gets the features of the last review.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom.fixed_values import DAYS_PER_YEAR
from feedloom.operators.point_in_time import DAY, seconds_between

MICROS = 1_000_000  # of money: amounts are added as whole numbers, as `prefix` adds decimals of six places
ORDER, REVIEW = "order", "review"
EVENT_DDL = "kind STRING, customer_id {key}, event_id {key}, at TIMESTAMP, amount BIGINT"
STATE_DDL = "customers STRING"
BUCKETS = 4_096  # of customers, which share a state; a matter of speed only, but fixed for a checkpoint
OUT = "customer_id {key}, review_id {key}, at_us BIGINT, order_count BIGINT, spent BIGINT, last_order_us BIGINT, " \
      "previous_reviews BIGINT"


def events_of(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders and reviews as one table of events, in the layout that the stream reads."""
    amount = (F.coalesce(F.col("order_total"), F.lit(0)).cast("decimal(28,6)") * MICROS).cast("bigint")
    return orders.select(F.lit(ORDER).alias("kind"), "customer_id", F.col("order_id").alias("event_id"),
                         F.col("ordered_at").cast("timestamp").alias("at"), amount.alias("amount")).unionByName(
        reviews.select(F.lit(REVIEW).alias("kind"), "customer_id", F.col("review_id").alias("event_id"),
                       F.col("reviewed_at").cast("timestamp").alias("at"), F.lit(0).cast("bigint").alias("amount")))


class Totals:
    """What is known of a customer before the watermark."""

    def __init__(self, orders: int = 0, spent: int = 0, last: int | None = None, reviews: int = 0):
        self.orders, self.spent, self.last, self.reviews = orders, spent, last, reviews

    def row(self) -> tuple:
        return self.orders, self.spent, self.last, self.reviews

    def take(self, events: list[list]) -> Iterator[tuple]:
        """Take in sorted events; yields (review, time, totals strictly before it) of every review among them."""
        same: list[list] = []
        for event in [*events, None]:
            if same and (event is None or event[0] != same[0][0]):
                for at, kind, amount, _ in same:
                    if kind == ORDER:
                        self.orders, self.spent, self.last = self.orders + 1, self.spent + amount, at
                    else:
                        self.reviews += 1
                same = []
            if event is not None:
                if event[1] == REVIEW:
                    yield event[3], event[0], self.row()
                same.append(event)


def _whole(ids: list) -> list:
    """Ids as they were before pandas made fractions of whole numbers beside a null."""
    return [None if i is None or i != i else int(i) if isinstance(i, float) else i for i in ids]


def feature_rows(events: DataFrame, delay: str, *, buckets: int = BUCKETS) -> DataFrame:
    """The stream of finished reviews and late events, from a stream of events.

    Customers share a state by the hash of their id, so that Python is called per bucket and not per customer.
    """
    kind = dict(events.dtypes)["customer_id"]
    columns = [part.split()[0] for part in OUT.split(", ")]
    types = dict.fromkeys(columns if kind == "bigint" else columns[2:], "Int64")

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        known = {customer: (Totals(*row), waiting) for customer, *row, waiting in json.loads(state.get[0])} \
            if state.exists else {}
        for batch in batches:
            for customer, at, what, amount, event in zip(
                    batch["customer_id"].tolist(), batch["at"].astype("datetime64[us]").astype("int64").tolist(),
                    batch["kind"].tolist(), batch["amount"].tolist(), _whole(batch["event_id"].tolist())):
                if customer not in known:
                    known[customer] = (Totals(), [])
                known[customer][1].append([at, what, amount, event])
        out, first = [], None
        for customer, (totals, waiting) in known.items():
            if not waiting:
                continue
            waiting.sort(key=lambda e: e[0])
            ready = [e for e in waiting if e[0] < mark]
            del waiting[:len(ready)]
            out += [(customer, review, at, *before) for review, at, before in totals.take(ready)]
            if waiting and (first is None or waiting[0][0] < first):
                first = waiting[0][0]
        state.update((json.dumps([[customer, *totals.row(), waiting] for customer, (totals, waiting) in known.items()]),))
        if first is not None:
            state.setTimeoutTimestamp(max(first // 1000, mark // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=columns).astype(types)

    placed = events.where(F.col("customer_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    return placed.withColumn("bucket", F.pmod(F.xxhash64("customer_id"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        advance, OUT.format(key=kind), STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)


def feature_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, *, key_type: str = "STRING",
                   delay: str = "90 days", files_per_batch: int = 1000, buckets: int = BUCKETS) -> StreamingQuery:
    """Run over the events that have arrived in `source` since the last run, then stop; finished rows go to `sink`."""
    arriving = spark.readStream.schema(EVENT_DDL.format(key=key_type)) \
        .option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (feature_rows(arriving, delay, buckets=buckets).writeStream.format("parquet").outputMode("append").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def finished_features(spark: SparkSession, sink: str, customers: DataFrame, key_type: str = "STRING") -> DataFrame:
    """`review_features` of every review that has left the stream."""
    rows = spark.read.schema(OUT.format(key=key_type)).parquet(sink)
    moment = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("at_us", "last_order_us")}
    people = customers.select("customer_id", "signup_at", "date_of_birth", "gender", "country")
    return rows.withColumns(moment).join(people, "customer_id").select(
        "review_id", "customer_id", (seconds_between("signup_at", "at_us") / DAY).alias("tenure_days"),
        F.round((F.col("spent").cast("decimal(28,6)") / MICROS).cast("double"), 2).alias("lifetime_revenue"), "order_count",
        (seconds_between("last_order_us", "at_us") / DAY).alias("days_since_last_order"), "previous_reviews",
        F.floor(F.datediff(F.col("at_us").cast("date"), "date_of_birth") / DAYS_PER_YEAR).cast("int").alias("age"),
        "gender", "country")


def late_events(query: StreamingQuery) -> int:
    """How many events of this run came too late and were dropped."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
