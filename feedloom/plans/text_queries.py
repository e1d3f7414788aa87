"""Briefs, prompts, text cache, backlog and estimates; order profiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from feedloom.fixed_values import FEELINGS, HOLIDAYS, WRITER_LANGUAGE_NAMES, WRITER_PROMPT, WRITER_SYSTEM
from feedloom.functions import profile as formulas
from feedloom.operators import calendar, profile, texts
from feedloom.plans.classify_queries import rounded
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import VIEWS, check_sql, text
from feedloom.plans.feature_queries import AS_OF, longs
from feedloom.plans.registry import query

WRITER = "writer-1"
OTHER_WRITER = "writer-2"

FEELING_SQL = "CASE " + " ".join(
    f"ELSE {text(w)}" if b is None else f"WHEN satisfaction < {b}::DOUBLE THEN {text(w)}" for b, w in FEELINGS) + " END"
LANGUAGE_SQL = "CASE language " + " ".join(
    f"WHEN {text(k)} THEN {text(v)}" for k, v in WRITER_LANGUAGE_NAMES.items()) + " ELSE language END"

VIEWS["bought"] = (["placed", "order_lines"], """
    SELECT DISTINCT customer_id, product_id FROM order_lines JOIN placed USING (order_id)""")
VIEWS["briefs"] = (["reviews", "review_truth", "products"], """
    SELECT r.review_id, r.reviewed_at, p.product_name, p.category AS product_category, p.description AS product_description,
      r.rating, t.satisfaction, t.aspect, t.language,
      2 + (('0x' || substr(sha256(r.review_id::VARCHAR), 1, 16))::UBIGINT % 6)::BIGINT AS sentences
    FROM reviews r JOIN review_truth t USING (review_id) JOIN products p USING (product_id)""")
PROMPT_VALUES = {"feeling": FEELING_SQL, "aspect": "replace(aspect, '_', ' ')", "language": LANGUAGE_SQL}
PROMPT_SQL = " || ".join(PROMPT_VALUES.get(part, part) if k % 2 else text(part)
                         for k, part in enumerate(re.split(r"\{(\w+)\}", WRITER_PROMPT)))
VIEWS["prompts"] = (["briefs"], f"SELECT *, {PROMPT_SQL} AS prompt FROM briefs")


def hash_sql(model: str) -> str:
    return f"substr(sha256('{model}' || chr(31) || {text(WRITER_SYSTEM)} || chr(31) || prompt), 1, 16)"


def briefs(d: Domain):
    return texts.review_briefs(d.reviews, d.review_truth, d.products)


@query("review_briefs", check_sql("""
    SELECT review_id, product_name, product_category, product_description, rating::BIGINT AS rating, satisfaction, aspect,
      language FROM briefs""", "briefs"))
def review_briefs(d: Domain):
    return briefs(d).withColumn("rating", F.col("rating").cast("bigint"))


@query("brief_lengths", check_sql("SELECT review_id, sentences FROM briefs", "briefs"))
def brief_lengths(d: Domain):
    return briefs(d).select("review_id", texts.brief_length(F.col("review_id")).cast("bigint").alias("sentences"))


@query("feeling_bands", check_sql(f"""
    SELECT {FEELING_SQL} AS feeling, count(*) AS reviews FROM briefs GROUP BY 1""", "briefs"))
def feeling_bands(d: Domain):
    return briefs(d).groupBy(texts.feeling(F.col("satisfaction")).alias("feeling")).agg(
        F.count(F.lit(1)).alias("reviews"))


@query("render_prompts", check_sql("SELECT review_id, prompt FROM prompts", "prompts"))
def render_prompts(d: Domain):
    return texts.with_prompt(briefs(d), WRITER).select("review_id", "prompt")


@query("prompt_hashes", check_sql(f"""
    SELECT review_id, {hash_sql(WRITER)} AS prompt_hash, {hash_sql(OTHER_WRITER)} AS other_hash FROM prompts""", "prompts"))
def prompt_hashes(d: Domain):
    first = texts.with_prompt(briefs(d), WRITER)
    return texts.with_prompt(first.withColumnRenamed("prompt_hash", "first_hash"), OTHER_WRITER).select(
        "review_id", F.col("first_hash").alias("prompt_hash"), F.col("prompt_hash").alias("other_hash"))


def text_cache(d: Domain):
    """Texts stored so far: every prompt of reviews up to a date, under the current writer."""
    known = texts.with_prompt(briefs(d), WRITER).select("review_id", "prompt_hash")
    early = d.reviews.where(F.col("reviewed_at") <= F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")).select("review_id")
    return known.join(early, "review_id", "left_semi").join(d.review_texts, "review_id")


@query("text_cache_split", check_sql(f"""
    SELECT review_id, CASE WHEN reviewed_at <= TIMESTAMP '{AS_OF}' THEN 'cached' ELSE 'to write' END AS state
    FROM prompts""", "prompts"))
def text_cache_split(d: Domain):
    prompted = texts.with_prompt(briefs(d), WRITER)
    cache = text_cache(d)
    hits = texts.cached_texts(prompted, cache).select("review_id", F.lit("cached").alias("state"))
    return hits.unionByName(texts.texts_to_write(prompted, cache).select("review_id", F.lit("to write").alias("state")))


@query("text_backlog", check_sql(f"""
    SELECT review_id, product_name, aspect, language FROM briefs
    WHERE reviewed_at > TIMESTAMP '{AS_OF}'""", "briefs"))
def text_backlog(d: Domain):
    written = d.review_texts.join(
        d.reviews.where(F.col("reviewed_at") <= F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")).select("review_id"),
        "review_id", "left_semi")
    return texts.text_backlog(d.reviews, written, d.review_truth, d.products).select(
        "review_id", "product_name", "aspect", "language")


@query("batch_estimate", check_sql("""
    SELECT reviews, sentences, sentences * 2750 AS classifier_tokens, reviews * 260 AS writer_input_tokens,
      sentences * 28 AS writer_output_tokens, round(sentences * 2750 / 1e6 * 0.042::DOUBLE, 6) AS classifier_usd,
      round(sentences * 0.3::DOUBLE / 8 / 60, 6) AS classifier_minutes,
      round(reviews * 260 / 1e6 * 1.25::DOUBLE + sentences * 28 / 1e6 * 10::DOUBLE, 6) AS writer_usd,
      round(reviews * 2.5::DOUBLE / 8 / 60, 6) AS writer_minutes
    FROM (SELECT count(*) AS reviews, sum(sentences)::BIGINT AS sentences FROM briefs)""", "briefs"))
def batch_estimate(d: Domain):
    estimated = texts.batch_estimate(briefs(d), usd_per_million_input=1.25, usd_per_million_output=10.0)
    return estimated.select("reviews", "sentences", "classifier_tokens", "writer_input_tokens", "writer_output_tokens",
                            *rounded(["classifier_usd", "classifier_minutes", "writer_usd", "writer_minutes"]))


SOUTH = ["NATION_0", "NATION_5", "NATION_10", "NATION_15"]
SOUTH_SQL = ", ".join(text(c) for c in SOUTH)


@query("monthly_share", check_sql(f"""
    SELECT southern, month, orders, round(orders / sum(orders) OVER (PARTITION BY southern), 4) AS share FROM (
      SELECT country IN ({SOUTH_SQL}) AS southern, month(ordered_at) AS month, count(*) AS orders
      FROM placed JOIN customers USING (customer_id)
      WHERE year(ordered_at) < (SELECT CASE WHEN max(month(ordered_at)) = 12 THEN y + 1 ELSE y END
                                FROM (SELECT *, max(year(ordered_at)) OVER () AS y FROM placed)
                                WHERE year(ordered_at) = y GROUP BY y)
      GROUP BY 1, 2)""",
    "placed", "customers"))
def monthly_share(d: Domain):
    # whole years only: the last one counts if it has come to December
    last = d.orders.agg(F.max("ordered_at")).first()[0]
    until = f"{last.year + 1 if last.month == 12 else last.year}-01-01"
    return profile.monthly_share(d.orders, d.customers, SOUTH, until=until).select(
        "southern", *longs("month"), "orders", "share")


def _holiday_sql(month: int, day: int, boost: float, width: float) -> str:
    away = ", ".join(f"abs(date_diff('second', make_timestamp(year(ordered_at) {s}, {month}, {day}, 0, 0, 0), ordered_at))"
                     for s in ("- 1", "+ 0", "+ 1"))
    return f"{boost}::DOUBLE * exp(-0.5::DOUBLE * pow(least({away}) / 86400 / {width}::DOUBLE, 2))"


SEASONALITY = check_sql(f"""
    SELECT order_id, round(1 + 0.6::DOUBLE * cos((dayofyear(ordered_at) + hour(ordered_at) / 24::DOUBLE - CASE
        WHEN country IN ({SOUTH_SQL}) THEN 196 + 365.25::DOUBLE / 2 ELSE 196 END) * 2 * pi() / 365.25::DOUBLE)
      + {' + '.join(_holiday_sql(*h) for h in HOLIDAYS)}, 6) AS seasonality
    FROM placed JOIN customers USING (customer_id)""", "placed", "customers")


@query("seasonality_index", SEASONALITY)
def seasonality_index(d: Domain):
    placed = d.orders.join(d.customers.select("customer_id", "country"), "customer_id")
    return placed.select("order_id", F.round(
        formulas.seasonality_index("ordered_at", F.col("country").isin(SOUTH)), 6).alias("seasonality"))


@query("repeat_purchase", check_sql("""
    SELECT median(n) AS median_orders FROM (
      SELECT customer_id, count(DISTINCT order_id) AS n FROM order_lines JOIN placed USING (order_id)
      WHERE product_id IN (13, 14, 15, 16, 17) GROUP BY 1)""", "placed", "order_lines"))
def repeat_purchase(d: Domain):
    return profile.repeat_purchase(d.orders, d.order_lines, [13, 14, 15, 16, 17])


@query("affinity_lift", check_sql("""
    SELECT customers, buyers, also_buyers, "both", round("both" / buyers, 4) AS rate,
      round(also_buyers / customers, 4) AS base_rate,
      round((also_buyers - "both") / (customers - buyers), 4) AS rate_of_others,
      round(("both" / buyers) / (also_buyers / customers), 4) AS lift
    FROM (SELECT count(*) AS customers, count(*) FILTER (a) AS buyers, count(*) FILTER (b) AS also_buyers,
            count(*) FILTER (a AND b) AS "both"
          FROM (SELECT o.customer_id, coalesce(bool_or(p.category = 'PROMO' AND p.list_price > 1500), false) AS a,
                  coalesce(bool_or(p.category = 'SMALL' AND p.list_price < 1200), false) AS b
                FROM placed o LEFT JOIN order_lines l USING (order_id) LEFT JOIN products p USING (product_id) GROUP BY 1))""",
    "placed", "order_lines", "products"))
def affinity_lift(d: Domain):
    return profile.affinity_lift(d.orders, d.order_lines, d.products,
                                 (F.col("category") == "PROMO") & (F.col("list_price") > 1500),
                                 (F.col("category") == "SMALL") & (F.col("list_price") < 1200))


LEAST_BUYERS = 3


@query("affinity_pairs", check_sql(f"""
    SELECT product_a, product_b, "both", a.buyers AS buyers_a, b.buyers AS buyers_b, customers,
      round("both"::DOUBLE * customers / (a.buyers * b.buyers), 4) AS lift
    FROM (SELECT a.product_id AS product_a, b.product_id AS product_b, count(*) AS "both"
          FROM bought a JOIN bought b ON a.customer_id = b.customer_id AND a.product_id < b.product_id
          GROUP BY 1, 2 HAVING count(*) >= {LEAST_BUYERS})
    JOIN (SELECT product_id, count(*) AS buyers FROM bought GROUP BY 1) a ON a.product_id = product_a
    JOIN (SELECT product_id, count(*) AS buyers FROM bought GROUP BY 1) b ON b.product_id = product_b,
    (SELECT count(DISTINCT customer_id) AS customers FROM placed)""", "bought"))
def affinity_pairs(d: Domain):
    return profile.affinity_pairs(d.orders, d.order_lines, least=LEAST_BUYERS)


@query("sold_before_launch", check_sql("""
    SELECT product_id, count(*) AS lines FROM order_lines JOIN placed USING (order_id) JOIN products USING (product_id)
    WHERE ordered_at::DATE < launched_on GROUP BY 1""", "placed", "order_lines", "products"))
def sold_before_launch(d: Domain):
    return profile.sold_before_launch(d.orders, d.order_lines, d.products).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"))


@query("review_propensity", check_sql("""
    SELECT review_id, round(0.03::DOUBLE + 0.45::DOUBLE * pow(abs(satisfaction * 2 - 1), 2.5::DOUBLE), 6) AS probability,
      greatest(1, least(5, round_even(1 + satisfaction * 4 + noise * 0.35::DOUBLE, 0)))::BIGINT AS rating
    FROM (SELECT review_id, satisfaction, (review_id % 13 - 6) / 3::DOUBLE AS noise FROM review_truth)""", "review_truth"))
def review_propensity(d: Domain):
    noise = (F.col("review_id") % 13 - 6) / 3
    return d.review_truth.select(
        "review_id", F.round(formulas.review_probability(F.col("satisfaction")), 6).alias("probability"),
        formulas.expected_rating(F.col("satisfaction"), noise).cast("bigint").alias("rating"))


@query("seasonality_from_calendar", SEASONALITY)
def seasonality_from_calendar(d: Domain):
    # the holidays as a table, one row per year and holiday, met by an interval join
    years = d.orders.agg(F.min(F.year("ordered_at")).alias("a"), F.max(F.year("ordered_at")).alias("z")).select(
        F.explode(F.sequence(F.col("a") - 1, F.col("z") + 1)).alias("year"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(day).alias("day"), F.lit(boost).alias("boost"),
                                        F.lit(width).alias("width")) for m, day, boost, width in HOLIDAYS]))
    held = years.select("year", each.alias("h")).select(
        F.make_timestamp_ntz("year", "h.m", "h.day", F.lit(0), F.lit(0), F.lit(0)).alias("held_at"), "h.boost", "h.width")
    orders = d.orders.join(d.customers.select("customer_id", "country"), "customer_id")
    wave = formulas.seasonality_index("ordered_at", F.col("country").isin(SOUTH), holidays=[])
    return calendar.with_boost(orders, "ordered_at", held).select(
        "order_id", F.round(wave + F.col("boost"), 6).alias("seasonality"))
