"""Point-in-time features, loading and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.keys import product_slug
from feedloom.operators import load, point_in_time as pit, sentences
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import check_sql, split_array
from feedloom.plans.registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"


def stamp(column: str):
    return F.date_format(column, STAMP).alias(column)


def longs(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


@query("pit_orders", check_sql(f"""
    SELECT l.order_id, l.customer_id, count(e.order_id) AS earlier_orders,
      round(coalesce(sum(e.order_total), 0), 2) AS earlier_revenue, strftime(max(e.ordered_at), {SQL_STAMP}) AS last_order_at
    FROM placed l LEFT JOIN placed e ON e.customer_id = l.customer_id AND e.ordered_at < l.ordered_at
    GROUP BY 1, 2""", "placed"))
def pit_orders(d: Domain):
    left = d.orders.select("order_id", "customer_id", "ordered_at")
    known = pit.point_in_time(left, d.orders, by="customer_id", at="ordered_at", event_time="ordered_at",
                              sums={"earlier_revenue": "order_total"}, count="earlier_orders",
                              last_event="last_order_at")
    return known.select("order_id", "customer_id", "earlier_orders",
                        F.round("earlier_revenue", 2).alias("earlier_revenue"), stamp("last_order_at"))


@query("pit_events", f"""
    SELECT l.event_id, count(e.event_id) AS purchases, round(coalesce(sum(e.value), 0), 2) AS spent,
      strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_purchase
    FROM events l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'purchase' AND e.ts < l.ts
    WHERE l.event_type = 'error' GROUP BY 1""")
def pit_events(d: Domain):
    events = d.raw("events")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    known = pit.point_in_time(errors, events.where("event_type = 'purchase'"), by="user_id", at="ts", event_time="ts",
                              sums={"spent": "value"}, count="purchases", last_event="last_purchase")
    return known.select("event_id", "purchases", F.round("spent", 2).alias("spent"), stamp("last_purchase"))


@query("running_totals", check_sql(f"""
    SELECT customer_id, strftime(ordered_at, {SQL_STAMP}) AS ordered_at, round(revenue, 2) AS revenue, orders FROM (
      SELECT customer_id, ordered_at, sum(t) OVER w AS revenue, (sum(n) OVER w)::BIGINT AS orders
      FROM (SELECT customer_id, ordered_at, sum(order_total) AS t, count(*) AS n FROM placed GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY customer_id ORDER BY ordered_at ROWS UNBOUNDED PRECEDING))""", "placed"))
def running_totals(d: Domain):
    totals = pit.running_totals(d.orders, by="customer_id", at="ordered_at", sums={"revenue": "order_total"},
                                count="orders")
    return totals.select("customer_id", stamp("ordered_at"), F.round("revenue", 2).alias("revenue"), *longs("orders"))


@query("running_totals_sliced", check_sql(f"""
    SELECT customer_id, strftime(ordered_at, {SQL_STAMP}) AS ordered_at, round(revenue, 2) AS revenue, orders FROM (
      SELECT customer_id, ordered_at, sum(t) OVER w AS revenue, (sum(n) OVER w)::BIGINT AS orders
      FROM (SELECT customer_id, ordered_at, sum(order_total) AS t, count(*) AS n FROM placed GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY customer_id ORDER BY ordered_at ROWS UNBOUNDED PRECEDING))""", "placed"))
def running_totals_sliced(d: Domain):
    totals = pit.running_totals(d.orders, by="customer_id", at="ordered_at", sums={"revenue": "order_total"},
                                count="orders", busy_rows=0)
    return totals.select("customer_id", stamp("ordered_at"), F.round("revenue", 2).alias("revenue"), *longs("orders"))


@query("asof_last_event", """
    SELECT l.event_id, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_click
    FROM events l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'click' AND e.ts < l.ts
    WHERE l.event_type = 'purchase' GROUP BY 1""")
def asof_last_event(d: Domain):
    events = d.raw("events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    known = pit.point_in_time(purchases, events.where("event_type = 'click'"), by="user_id", at="ts",
                              event_time="ts", last_event="last_click")
    return known.select("event_id", stamp("last_click"))


FEATURE_COLUMNS = ("review_id, customer_id, round(tenure_days, 4) AS tenure_days, lifetime_revenue, order_count, "
                   "round(days_since_last_order, 4) AS days_since_last_order, previous_reviews, age::BIGINT AS age, "
                   "gender, country")


def feature_columns():
    return ["review_id", "customer_id", F.round("tenure_days", 4).alias("tenure_days"), "lifetime_revenue",
            "order_count", F.round("days_since_last_order", 4).alias("days_since_last_order"), "previous_reviews",
            *longs("age"), "gender", "country"]


@query("review_features", check_sql(f"SELECT {FEATURE_COLUMNS} FROM features", "features"))
def review_features(d: Domain):
    return pit.review_features(d.reviews, d.customers, d.orders).select(feature_columns())


@query("previous_events", check_sql("""
    SELECT l.event_id, count(e.event_id) AS previous_events
    FROM events l LEFT JOIN events e ON e.user_id = l.user_id AND e.ts < l.ts GROUP BY 1"""))
def previous_events(d: Domain):
    events = d.raw("events").select("event_id", "user_id", "ts")
    return pit.point_in_time(events, events, by="user_id", at="ts", event_time="ts", count="previous_events") \
        .select("event_id", "previous_events")


@query("pit_leakage_check", check_sql("SELECT count(*) AS reviews, 0::BIGINT AS changed FROM features", "features"))
def pit_leakage_check(d: Domain):
    latest = d.reviews.groupBy("customer_id").agg(F.max("reviewed_at").alias("latest"))
    later = F.expr("latest + INTERVAL 1 SECOND")
    orders = latest.select("customer_id", later.alias("ordered_at"), F.lit(1_000_000.0).alias("order_total"))
    reviews = latest.select(F.lit(-1).cast("bigint").alias("review_id"), "customer_id", later.alias("reviewed_at"))
    return pit.leakage_check(d.reviews, d.customers, d.orders, orders, reviews)


@query("load_reviews", check_sql(f"""
    SELECT review_key, product_id, product_name, product_category, rating::BIGINT AS rating,
      strftime(reviewed_at, {SQL_STAMP}) AS reviewed_at, sha1(review_text) AS review_text_sha1, text_language, text_model,
      {FEATURE_COLUMNS} FROM loaded""", "loaded"))
def load_reviews(d: Domain):
    return d.loaded.select("review_key", "product_id", "product_name", "product_category", *longs("rating"),
                           stamp("reviewed_at"), F.sha1("review_text").alias("review_text_sha1"), "text_language",
                           "text_model", *feature_columns())


AS_OF = "2000-01-01 00:00:00"


@query("reviews_missing_text", check_sql(f"""
    SELECT count(*) AS reviews, count(*) FILTER (reviewed_at > TIMESTAMP '{AS_OF}') AS missing_text
    FROM reviews""", "reviews"))
def reviews_missing_text(d: Domain):
    # texts exist for the reviews written up to a date; the later ones are excluded and counted
    written = d.reviews.where(F.col("reviewed_at") <= F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")).select("review_id")
    tables = d.tables | {"review_texts": d.review_texts.join(written, "review_id", "left_semi")}
    missing = load.missing_texts(tables).select("review_id", F.lit(1).alias("absent"))
    return d.reviews.join(missing, "review_id", "left").agg(
        F.count(F.lit(1)).alias("reviews"), F.count("absent").alias("missing_text"))


@query("content_keys", check_sql("SELECT review_id, review_key FROM texts", "texts"))
def content_keys(d: Domain):
    return d.texts.select("review_id", "review_key")


@query("product_catalogue", check_sql("""
    SELECT product_name, category AS product_category FROM products""", "products"))
def product_catalogue(d: Domain):
    return load.product_catalogue(d.products)


@query("distinct_texts", check_sql("""
    SELECT count(*) AS reviews, count(DISTINCT review_key) AS distinct_texts FROM texts""", "texts"))
def distinct_texts(d: Domain):
    return load.distinct_texts(d.texts)


@query("busiest_entity_history", check_sql(f"""
    SELECT review_id, customer_id, strftime(reviewed_at, {SQL_STAMP}) AS reviewed_at, product_name, rating::BIGINT AS rating,
      round(tenure_days) AS tenure_days, lifetime_revenue, order_count, previous_reviews
    FROM loaded WHERE customer_id = (SELECT customer_id FROM loaded GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "loaded"))
def busiest_entity_history(d: Domain):
    return load.busiest_customer_history(d.loaded.drop("review_text")).select(
        "review_id", "customer_id", stamp("reviewed_at"), "product_name", *longs("rating"),
        F.round("tenure_days").alias("tenure_days"), "lifetime_revenue", "order_count", "previous_reviews")


@query("split_sentences", check_sql("""
    SELECT review_id, sentence_index, sentence_count, sentence FROM sentences""", "sentences"))
def split_sentences(d: Domain):
    return d.sentences.select("review_id", *longs("sentence_index", "sentence_count"), "sentence")


@query("sentence_counts", check_sql("""
    SELECT review_id, max(sentence_count) AS sentence_count FROM sentences GROUP BY 1""", "sentences"))
def sentence_counts(d: Domain):
    return sentences.sentence_counts(d.review_texts).select("review_id", *longs("sentence_count"))


@query("split_conversations", f"""
    SELECT conv_id, turn, len(pieces) AS sentence_count, unnest(pieces) AS sentence,
      unnest(range(len(pieces))) AS sentence_index
    FROM (SELECT conv_id, turn, {split_array('text')} AS pieces FROM conversations)""")
def split_conversations(d: Domain):
    turns = d.raw("conversations").select("conv_id", "turn", F.col("text").alias("review_text"))
    return sentences.split_sentences(turns).select("conv_id", "turn", *longs("sentence_index", "sentence_count"),
                                                   "sentence")


@query("product_slugs", check_sql("""
    SELECT product_name, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug
    FROM products""", "products"))
def product_slugs(d: Domain):
    return d.products.select("product_name", product_slug(F.col("product_name")).alias("slug"))
