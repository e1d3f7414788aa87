"""Roll-ups, sentiments, risk tiers, flows and queues on a small set of classified sentences."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.fixed_values import FLOW_LEVELS
from feedloom.operators import dashboard, insights

DDL = ("review_id STRING, review_key STRING, customer_id STRING, product_id STRING, product_name STRING, "
       "product_category STRING, rating INT, reviewed_at TIMESTAMP_NTZ, review_text STRING, text_language STRING, "
       "text_model STRING, tenure_days DOUBLE, lifetime_revenue DOUBLE, order_count INT, days_since_last_order DOUBLE, "
       "previous_reviews INT, age INT, gender STRING, country STRING, sentence_index INT, sentence STRING, "
       "sentiment STRING, problem_category STRING, problem_category_confidence DOUBLE, frustration DOUBLE, "
       "products_mentioned ARRAY<STRING>, churn_risk DOUBLE, safety_concern DOUBLE, suggestion DOUBLE, "
       "competitor_mention DOUBLE")


def row(review, customer, i, sentiment, problem, frustration, *, dom=1, rating=2, product="Kettle", revenue=50.0,
        churn=0.1, mentioned=(), confidence=0.9, text=None):
    return (review, f"key{review}", customer, f"P-{product}", product, "kitchen", rating, datetime(2025, 1, dom),
            text or f"text of {review}", "english", "writer", 10.0, revenue, 1, 2.0, 0, 40, "female", "Canada", i,
            f"sentence {i}", sentiment, problem, confidence, frustration, list(mentioned), churn, 0.0, 0.0, 0.0)


ROWS = [
    row("R1", "A", 0, "negative", "performance", 1.5, mentioned=["Kettle", "Stove"]),
    row("R1", "A", 1, "negative", "build_quality", 3.2, mentioned=["Kettle"]),
    row("R1", "A", 2, "positive", "none", 0.0),
    row("R2", "B", 0, "positive", "none", 0.0, rating=5, product="Stove"),
    row("R2", "B", 1, "positive", "none", 0.0, rating=5, product="Stove"),
    row("R3", "A", 0, "positive", "none", 0.0, dom=9, rating=3, revenue=80.0),
    row("R3", "A", 1, "negative", "price_value", 1.0, dom=9, rating=3, revenue=80.0, churn=0.9, confidence=0.4),
]


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="module")
def reviews(sentences):
    return dashboard.assign_risk(insights.reviews_view(sentences))


def column(df, name, order="review_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rollup(sentences):
    rows = insights.review_rollup(sentences).orderBy("review_id").collect()
    first = rows[0]
    assert (first.sentences, first.peak_frustration, first.mean_frustration) == (3, 3.2, pytest.approx(4.7 / 3))
    assert first.problems == ["build_quality", "performance"]
    assert first.products_mentioned == ["Kettle", "Stove"]
    assert [r.churn_risk for r in rows] == [False, False, True]
    assert first.review_text == "text of R1"


def test_facts_may_come_from_a_reviews_table(sentences):
    facts = sentences.select("review_id", "review_key", "rating", "product_name").distinct()
    measured = sentences.drop("rating", "product_name", "review_id")
    a = insights.reviews_view(sentences).select("review_id", "sentences", "problems", "primary_issue", "star_sentiment")
    b = insights.reviews_view(measured, facts=facts, key="review_key").select(*a.columns)
    assert sorted(a.collect()) == sorted(b.collect())


def test_issue_and_sentiments(reviews):
    assert column(reviews, "primary_issue") == ["build_quality", "no_issue", "price_value"]
    assert column(reviews, "text_sentiment") == ["negative", "positive", "mixed"]
    assert column(reviews, "star_sentiment") == ["negative", "positive", "mixed"]


def test_risk(reviews):
    assert column(reviews, "risk_tier") == ["At risk", "Satisfied", "At risk"]
    strict = dashboard.assign_risk(reviews, at_risk_frustration=4.0, frustrated_frustration=3.0)
    assert column(strict, "risk_tier") == ["Frustrated", "Satisfied", "At risk"]


def test_failed_answers_count_as_sentences_only(spark):
    failed = [r[:21] + (None,) * 9 for r in ROWS[:2]]
    rolled = insights.reviews_view(spark.createDataFrame(failed, DDL)).first()
    assert (rolled.sentences, rolled.peak_frustration, rolled.problems, rolled.churn_risk) == (2, None, [], False)
    assert (rolled.primary_issue, rolled.text_sentiment) == ("no_issue", "mixed")


def test_customers_are_judged_on_their_latest_review(reviews):
    rows = {r.customer_id: r for r in dashboard.customers_view(reviews).collect()}
    assert (rows["A"].review_id, rows["A"].reviews_written, rows["A"].lifetime_revenue) == ("R3", 2, 80.0)
    assert rows["B"].reviews_written == 1


def test_flow_is_conserved(reviews):
    links = dashboard.sankey_links(reviews)
    assert {r.source_level: r.reviews for r in dashboard.sankey_conservation(links).collect()} == \
        dict.fromkeys(FLOW_LEVELS[:3], 3)
    nodes = dashboard.sankey_nodes(links).orderBy("index").collect()
    assert [n["index"] for n in nodes] == list(range(len(nodes)))
    assert [n.name for n in nodes[:3]] == ["negative", "mixed", "positive"]
    assert nodes[-1].name == "no_issue" and nodes[-1].level == "issue"
    assert [(n.name, n.reviews) for n in nodes if n.level == "product"] == [("Kettle", 2), ("Stove", 1)]


def test_headline_numbers(reviews):
    row = dashboard.kpis(reviews).first()
    assert (row.reviews, row.customers, row.negative_reviews) == (3, 2, 1)
    assert (row.customers_at_risk, row.at_risk_share, row.revenue_at_risk) == (1, 0.5, 80.0)
    assert row.revenue_at_risk_share == pytest.approx(80 / 130, abs=1e-4)
    # nothing to divide by
    assert dashboard.kpis(reviews.where("false")).first().negative_share is None


def test_problem_tables(sentences):
    problems = insights.problems_by_product(sentences)
    assert {(r.product_name, r.problem_category): (r.sentences, r.reviews, r.mean_frustration) for r in problems.collect()} \
        == {("Kettle", "performance"): (1, 1, 1.5), ("Kettle", "build_quality"): (1, 1, 3.2),
            ("Kettle", "price_value"): (1, 1, 1.0)}
    pivot = insights.problem_pivot(problems, ["performance", "safety"]).first()
    assert (pivot.performance, pivot.safety) == (1, 0)
    assert insights.top_problem_areas(problems).count() == 0
    assert [r.problem_category for r in insights.top_problem_areas(problems, min_reviews=1, n=1).collect()] == ["build_quality"]


def test_queues(sentences, reviews):
    assert [(r.product_name, r.also_mentions) for r in insights.cross_mentions(sentences).collect()] == [("Kettle", "Stove")]
    assert [(r.churn_risk, r.occurrences) for r in insights.flagged(sentences, "churn_risk").collect()] == [(0.9, 1)]
    assert [r.problem_category for r in insights.needs_review(sentences).collect()] == ["price_value"]
    assert [r.review_id for r in insights.most_frustrated(reviews, n=2).orderBy("review_id").collect()] == ["R1", "R3"]


def test_most_frustrated_shows_each_text_once(reviews):
    same = reviews.withColumn("review_text", F.lit("one"))
    assert [r.review_id for r in insights.most_frustrated(same).collect()] == ["R1"]


def test_filters_and_drilldown(reviews):
    assert dashboard.filtered_view(reviews).count() == 3
    assert dashboard.filtered_view(reviews, products=["Stove"], hide_no_issue=True).count() == 0
    assert column(dashboard.filtered_view(reviews, sentiments=["mixed"]), "review_id") == ["R3"]
    assert [r.review_id for r in dashboard.issue_drilldown(reviews, "price_value", "Kettle").collect()] == ["R3"]
    assert {r.primary_issue: r.label for r in dashboard.issue_counts(reviews).collect()} == {
        "build_quality": "Build quality", "no_issue": "No issue raised", "price_value": "Price value"}
    options = {(r.filter, r.value) for r in dashboard.filter_options(reviews).collect()}
    assert ("product_name", "Stove") in options and len(options) == 4


def test_rating_share_and_frustration(spark, reviews):
    lines = spark.range(30)
    shares = {r.rating: (r.reviews, r.share, r.reviewed_share) for r in insights.rating_share(reviews, lines).collect()}
    assert shares == {2: (1, 0.333, 0.1), 3: (1, 0.333, 0.1), 5: (1, 0.333, 0.1)}
    assert {r.rating: r.peak_frustration for r in insights.frustration_by_rating(reviews).collect()} == {2: 3.2, 3: 1.0, 5: 0.0}


def test_quadrants_part_at_the_medians(spark):
    rng = random.Random(1)
    rows = [(f"C{i}", float(rng.randrange(1000)), float(rng.randrange(500)), "Satisfied") for i in range(301)]
    people = spark.createDataFrame(rows, "customer_id STRING, tenure_days DOUBLE, lifetime_revenue DOUBLE, risk_tier STRING")
    quadrants = dashboard.value_quadrants(people).collect()
    assert sum(q.customers for q in quadrants) == 301
    tenures, revenues = sorted(r[1] for r in rows), sorted(r[2] for r in rows)
    assert {(q.median_tenure, q.median_revenue) for q in quadrants} == {(tenures[150], revenues[150])}


def test_a_hot_review_is_rolled_up_whole(spark, sentences):
    many = spark.range(5000).select(F.col("id").cast("int").alias("n"))
    one = sentences.where("review_id = 'R1' AND sentence_index = 0").drop("sentence_index")
    hot = one.crossJoin(many).withColumnRenamed("n", "sentence_index")
    rolled = insights.review_rollup(hot).first()
    assert (rolled.sentences, rolled.products_mentioned) == (5000, ["Kettle", "Stove"])
