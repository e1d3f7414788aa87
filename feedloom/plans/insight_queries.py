"""Roll-ups, risk, flows, dashboard numbers and work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.fixed_values import FLAGS, PROBLEM_CATEGORIES
from feedloom.operators import cube, dashboard, insights
from feedloom.plans.classify_queries import joined, rounded
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import cents, check_sql
from feedloom.plans.feature_queries import FEATURE_COLUMNS, SQL_STAMP, feature_columns, longs, stamp
from feedloom.plans.registry import query
from feedloom.session import materialise

PROBLEMS = [p for p in PROBLEM_CATEGORIES if p != "none"]

ROLLED = [*FLAGS, "product_name", "product_category", "text_language"]
SQL_ROLLED = (f"{FEATURE_COLUMNS}, {', '.join(ROLLED)}, sentences, round(peak_frustration, 6) AS peak_frustration, "
              "round(mean_frustration, 6) AS mean_frustration, array_to_string(problems, ';') AS problems, "
              "array_to_string(mentioned, ';') AS products_mentioned")


def rolled_columns():
    return [*feature_columns(), *ROLLED, "sentences", *rounded(["peak_frustration", "mean_frustration"]),
            joined("problems"), joined("products_mentioned")]


@query("review_rollup", check_sql(f"SELECT {SQL_ROLLED} FROM view", "view"))
def review_rollup(d: Domain):
    rolled = insights.review_rollup(d.answers(), facts=d.review_facts, key="review_key")
    return rolled.select(rolled_columns())


@query("review_rollup_from_sentences", check_sql("""
    SELECT review_id, v.product_name, v.sentences, round(v.peak_frustration, 6) AS peak_frustration,
      round(v.mean_frustration, 6) AS mean_frustration, array_to_string(v.problems, ';') AS problems, v.churn_risk
    FROM view v""", "view"))
def review_rollup_from_sentences(d: Domain):
    # the facts ride on the sentence rows here, as a caller without a reviews table has them
    return insights.review_rollup(d.classified()).select(
        "review_id", "product_name", "sentences", *rounded(["peak_frustration", "mean_frustration"]),
        joined("problems"), "churn_risk")


VIEWED = ["positive_sentences", "negative_sentences", "primary_issue", "text_sentiment", "star_sentiment"]


@query("reviews_view", check_sql(f"SELECT {SQL_ROLLED}, {', '.join(VIEWED)} FROM view", "view"))
def reviews_view(d: Domain):
    return d.reviews_view.select(*rolled_columns(), *VIEWED)


@query("primary_issue", check_sql("SELECT review_id, primary_issue FROM view", "view"))
def primary_issue(d: Domain):
    return d.reviews_view.select("review_id", "primary_issue")


@query("text_sentiment", check_sql("SELECT review_id, text_sentiment FROM view", "view"))
def text_sentiment(d: Domain):
    return d.reviews_view.select("review_id", "text_sentiment")


@query("star_sentiment", check_sql("""
    SELECT star_sentiment, count(*) AS reviews FROM view GROUP BY 1""", "view"))
def star_sentiment(d: Domain):
    return d.reviews_view.groupBy("star_sentiment").agg(F.count(F.lit(1)).alias("reviews"))


@query("risk_tiers", check_sql("""
    SELECT review_id, risk_tier, CASE WHEN churn_risk OR peak_frustration >= 4.0 THEN 'At risk'
      WHEN peak_frustration >= 3.9 THEN 'Frustrated' ELSE 'Satisfied' END AS strict_tier FROM view""", "view"))
def risk_tiers(d: Domain):
    usual = d.risky.withColumnRenamed("risk_tier", "usual_tier")
    strict = dashboard.assign_risk(usual, at_risk_frustration=4.0, frustrated_frustration=3.9)
    return strict.select("review_id", F.col("usual_tier").alias("risk_tier"), F.col("risk_tier").alias("strict_tier"))


@query("customers_view", check_sql(f"""
    SELECT {FEATURE_COLUMNS}, strftime(reviewed_at, {SQL_STAMP}) AS reviewed_at, primary_issue, risk_tier, reviews_written
    FROM people""", "people"))
def customers_view(d: Domain):
    return dashboard.customers_view(d.risky).select(*feature_columns(), stamp("reviewed_at"), "primary_issue",
                                                    "risk_tier", "reviews_written")


@query("sankey_links", check_sql("SELECT * FROM links", "links"))
def sankey_links(d: Domain):
    return dashboard.sankey_links(d.reviews_view)


@query("sankey_nodes", check_sql("""
    SELECT row_number() OVER (ORDER BY list_position(['sentiment', 'category', 'product', 'issue'], level),
        coalesce(list_position(['negative', 'mixed', 'positive'], name), 9), name = 'no_issue', reviews DESC,
        md5(name)) - 1 AS index, level, name, reviews
    FROM (SELECT target_level AS level, target AS name, sum(reviews)::BIGINT AS reviews FROM links GROUP BY 1, 2
          UNION ALL SELECT source_level, source, sum(reviews)::BIGINT FROM links
          WHERE source_level = 'sentiment' GROUP BY 1, 2)""", "links"))
def sankey_nodes(d: Domain):
    return dashboard.sankey_nodes(dashboard.sankey_links(d.reviews_view)).select(
        *longs("index"), "level", "name", "reviews")


@query("sankey_conservation", check_sql("""
    SELECT source_level, sum(reviews)::BIGINT AS reviews FROM links GROUP BY 1""", "links"))
def sankey_conservation(d: Domain):
    return dashboard.sankey_conservation(dashboard.sankey_links(d.reviews_view))


@query("frustration_by_rating", check_sql(f"""
    SELECT rating::BIGINT AS rating, count(*) AS reviews, {cents('avg(peak_frustration)')} AS peak_frustration,
      {cents('avg(mean_frustration)')} AS mean_frustration FROM view GROUP BY 1""", "view"))
def frustration_by_rating(d: Domain):
    return insights.frustration_by_rating(d.reviews_view).select(
        *longs("rating"), "reviews", "peak_frustration", "mean_frustration")


@query("problems_by_product", check_sql("SELECT * FROM problems", "problems"))
def problems_by_product(d: Domain):
    return insights.problems_by_product(d.classified("a", "problem_category", "frustration"))


@query("problem_pivot", check_sql(f"""
    SELECT product_name, {', '.join(
        f"coalesce(sum(sentences) FILTER (problem_category = '{p}'), 0)::BIGINT AS {p}" for p in PROBLEMS)}
    FROM problems GROUP BY 1""", "problems"))
def problem_pivot(d: Domain):
    return insights.problem_pivot(insights.problems_by_product(d.classified("a", "problem_category", "frustration")), PROBLEMS)


@query("top_problem_areas", check_sql("""
    SELECT * FROM problems WHERE reviews >= 3 ORDER BY mean_frustration DESC, product_name, problem_category LIMIT 10""",
    "problems"))
def top_problem_areas(d: Domain):
    return insights.top_problem_areas(insights.problems_by_product(d.classified("a", "problem_category", "frustration")))


@query("cross_mentions", check_sql("""
    SELECT DISTINCT product_name, also_mentions, sentence
    FROM (SELECT product_name, sentence, unnest(products_mentioned) AS also_mentions FROM classified)
    WHERE also_mentions <> product_name""", "classified"))
def cross_mentions(d: Domain):
    return insights.cross_mentions(d.classified())


def _register_flag(flag: str) -> None:
    @query(f"flagged_{flag}", check_sql(f"""
        SELECT product_name, sentence, {cents(f'arg_min({flag}, (review_id, sentence_index))')} AS {flag},
          count(*) AS occurrences, {cents('arg_min(frustration, (review_id, sentence_index))')} AS frustration
        FROM classified WHERE {flag} >= 0.5 GROUP BY 1, 2""", "classified"))
    def flagged(d: Domain):
        return insights.flagged(d.classified(), flag)


for _flag in FLAGS:
    _register_flag(_flag)


@query("needs_review", check_sql(f"""
    SELECT DISTINCT product_name, sentence, problem_category,
      {cents('problem_category_confidence')} AS problem_category_confidence
    FROM classified WHERE problem_category_confidence < 0.6""", "classified"))
def needs_review(d: Domain):
    return insights.needs_review(d.classified())


@query("language_confusion", check_sql("""
    SELECT text_language, language, count(*) AS sentences, round(min(language_confidence), 6) AS min_confidence
    FROM classified GROUP BY 1, 2""", "classified"))
def language_confusion(d: Domain):
    return insights.language_confusion(d.classified()).select(
        "text_language", "language", "sentences", *rounded(["min_confidence"]))


@query("most_frustrated", check_sql("""
    SELECT review_id, rating::BIGINT AS rating, product_name, round(peak_frustration, 2) AS peak_frustration, churn_risk,
      safety_concern, sha1(review_text) AS review_text_sha1
    FROM (SELECT *, row_number() OVER (PARTITION BY review_text ORDER BY peak_frustration DESC, review_id) AS position
          FROM (SELECT v.*, t.review_text, v.peak_frustration AS peak FROM view v JOIN review_texts t USING (review_id))
          WHERE peak_frustration IS NOT NULL)
    WHERE position = 1 ORDER BY peak DESC, review_id LIMIT 10""",
    "view", "review_texts"))
def most_frustrated(d: Domain):
    hashes = d.review_texts.select("review_id", F.sha1("review_text").alias("text_hash"))
    top = insights.most_frustrated(d.reviews_view.join(hashes, "review_id"), text="text_hash")
    return top.join(d.review_texts.select("review_id", "review_text"), "review_id").select(
        "review_id", *longs("rating"), "product_name", F.round("peak_frustration", 2).alias("peak_frustration"),
        "churn_risk", "safety_concern", F.sha1("review_text").alias("review_text_sha1"))


@query("rating_share", check_sql("""
    SELECT rating::BIGINT AS rating, count(*) AS reviews, round(count(*) / (SELECT count(*) FROM reviews), 3) AS share,
      round((SELECT count(*) FROM reviews) / (SELECT count(*) FROM order_lines), 4) AS reviewed_share
    FROM reviews GROUP BY 1""", "reviews", "order_lines"))
def rating_share(d: Domain):
    return insights.rating_share(d.reviews, d.order_lines).select(*longs("rating"), "reviews", "share",
                                                                  "reviewed_share")


SHOWN = {"categories": ["ECONOMY", "PROMO", "SMALL"], "countries": [f"NATION_{i}" for i in range(0, 25, 2)],
         "sentiments": ["negative", "mixed"], "hide_no_issue": True}


@query("filtered_view", check_sql(f"""
    SELECT review_id, product_category, country, text_sentiment, primary_issue FROM view
    WHERE product_category IN ('ECONOMY', 'PROMO', 'SMALL') AND country IN ({', '.join(repr(c) for c in SHOWN['countries'])})
      AND text_sentiment IN ('negative', 'mixed') AND primary_issue <> 'no_issue'""", "view"))
def filtered_view(d: Domain):
    return dashboard.filtered_view(d.reviews_view, **SHOWN).select(
        "review_id", "product_category", "country", "text_sentiment", "primary_issue")


@query("filter_options", check_sql("""
    SELECT DISTINCT 'product_category' AS filter, product_category AS value FROM view
    UNION SELECT 'product_name', product_name FROM view UNION SELECT 'country', country FROM view""", "view"))
def filter_options(d: Domain):
    return dashboard.filter_options(d.reviews_view)


@query("kpis", check_sql("""
    SELECT v.*, p.* EXCLUDE (customers), p.customers, round(negative_reviews / reviews, 4) AS negative_share FROM
      (SELECT count(*) AS reviews, count(*) FILTER (text_sentiment = 'negative') AS negative_reviews FROM view) v,
      (SELECT count(*) AS customers, count(*) FILTER (risk_tier = 'At risk') AS customers_at_risk,
         round(count(*) FILTER (risk_tier = 'At risk') / count(*), 4) AS at_risk_share,
         round(sum(lifetime_revenue) FILTER (risk_tier = 'At risk'), 2) AS revenue_at_risk,
         round(sum(lifetime_revenue) FILTER (risk_tier = 'At risk') / sum(lifetime_revenue), 4) AS revenue_at_risk_share
       FROM people) p""", "people"))
def kpis(d: Domain):
    return dashboard.kpis(d.risky)


CUBE_SETS = "CUBE (product_category, product_name, country, text_sentiment)"
CUBE_NAMES = ", ".join(f"CASE WHEN g{i} = 0 THEN '{c}' END" for i, c in enumerate(cube.FILTERS))


def _cube_sql(rows: str, raised: str) -> str:
    return f"""
    SELECT concat_ws('+', {CUBE_NAMES}, {raised}) AS filters, {', '.join(cube.FILTERS)},
      sum(reviews)::BIGINT AS reviews, sum(negative)::BIGINT AS negative_reviews, count(*) AS customers,
      count(*) FILTER (risk_tier = 'At risk') AS customers_at_risk,
      round(coalesce(sum(revenue) FILTER (risk_tier = 'At risk'), 0), 2) AS revenue_at_risk, round(sum(revenue), 2) AS revenue
    FROM (SELECT {', '.join(cube.FILTERS)}, {', '.join(f'grouping({c}) AS g{i}' for i, c in enumerate(cube.FILTERS))},
            customer_id, count(*) AS reviews, count(*) FILTER (text_sentiment_of = 'negative') AS negative,
            arg_max(risk_tier, (reviewed_at, review_id)) AS risk_tier,
            arg_max(lifetime_revenue, (reviewed_at, review_id)) AS revenue
          FROM (SELECT *, text_sentiment AS text_sentiment_of FROM view WHERE {rows})
          GROUP BY customer_id, {CUBE_SETS})
    GROUP BY g0, g1, g2, g3, {', '.join(cube.FILTERS)}"""


@query("kpi_cube", check_sql(_cube_sql("true", "NULL") + " UNION ALL " + _cube_sql(
    "primary_issue <> 'no_issue'", f"'{cube.RAISED}'"), "view"))
def kpi_cube(d: Domain):
    return cube.kpi_cube(d.risky).withColumns({c: F.col(c).cast("double") for c in ("revenue_at_risk", "revenue")})


@query("issue_counts", check_sql("""
    SELECT primary_issue, count(*) AS reviews, CASE WHEN primary_issue = 'no_issue' THEN 'No issue raised' ELSE
      upper(substr(primary_issue, 1, 1)) || replace(substr(primary_issue, 2), '_', ' ') END AS label
    FROM view GROUP BY 1""", "view"))
def issue_counts(d: Domain):
    return dashboard.issue_counts(d.reviews_view)


@query("issue_drilldown", check_sql(f"""
    SELECT review_id, strftime(reviewed_at, {SQL_STAMP}) AS reviewed_at, customer_id, rating::BIGINT AS rating,
      product_name, country, round(peak_frustration, 1) AS peak_frustration, 'Safety' AS issue, risk_tier,
      substr(review_text, 1, 110) AS excerpt, length(review_text) AS review_length
    FROM view JOIN review_texts USING (review_id) WHERE primary_issue = 'safety'""", "view", "review_texts"))
def issue_drilldown(d: Domain):
    chosen = dashboard.issue_drilldown(d.risky, "safety")
    return chosen.join(d.review_texts.select("review_id", "review_text"), "review_id").select(
        "review_id", stamp("reviewed_at"), "customer_id", *longs("rating"), "product_name", "country",
        F.round("peak_frustration", 1).alias("peak_frustration"), dashboard.pretty("primary_issue").alias("issue"),
        "risk_tier", dashboard.excerpt("review_text").alias("excerpt"),
        F.length("review_text").cast("bigint").alias("review_length"))


@query("at_risk_customers", check_sql("""
    SELECT customer_id, review_id, lifetime_revenue, primary_issue, reviews_written FROM people
    WHERE risk_tier = 'At risk'""", "people"))
def at_risk_customers(d: Domain):
    return dashboard.at_risk_customers(dashboard.customers_view(d.risky)).select(
        "customer_id", "review_id", "lifetime_revenue", "primary_issue", "reviews_written")


@query("value_quadrants", check_sql("""
    SELECT CASE WHEN tenure_days < m.t THEN 'newer' ELSE 'longer-standing' END AS tenure,
      CASE WHEN lifetime_revenue < m.r THEN 'lower' ELSE 'higher' END AS value, risk_tier,
      round(m.t, 4) AS median_tenure, round(m.r, 4) AS median_revenue, count(*) AS customers,
      round(sum(lifetime_revenue), 2) AS revenue
    FROM people, (SELECT median(tenure_days) AS t, median(lifetime_revenue) AS r FROM people) m GROUP BY ALL""", "people"))
def value_quadrants(d: Domain):
    people = dashboard.customers_view(d.risky.select(
        "customer_id", "review_id", "reviewed_at", "tenure_days", "lifetime_revenue", "risk_tier"))
    return dashboard.value_quadrants(materialise(people, "customers_view")).select(
        "tenure", "value", "risk_tier", *rounded(["median_tenure", "median_revenue"], 4), "customers", "revenue")


@query("result_meta", check_sql("""
    SELECT min(model) AS model, min(question_set_version) AS question_set_version,
      (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT text_model AS m FROM classified)) AS text_models
    FROM classified""", "classified"))
def result_meta(d: Domain):
    return insights.result_meta(d.classified())
