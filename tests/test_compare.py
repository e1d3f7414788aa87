"""Sampling, agreement, accuracy, speed and cost."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from feedloom.fixed_values import CHOICES, FLAGS
from feedloom.operators import compare
from feedloom.schemas import ANSWERS_DDL, conform


def sentence_rows(groups):
    """(language, rating, reviews, sentences each) -> rows."""
    rows, n = [], 0
    for language, rating, reviews, each in groups:
        for _ in range(reviews):
            n += 1
            rows += [(f"R{n}", f"k{n}", i, language, rating, "Kettle", f"s{i}") for i in range(each)]
    return rows


DDL = ("review_id STRING, review_key STRING, sentence_index INT, text_language STRING, rating INT, product_name STRING, "
       "sentence STRING")


def test_sample_covers_every_stratum_with_whole_reviews(spark):
    df = spark.createDataFrame(sentence_rows([("english", 5, 200, 4), ("zulu", 1, 1, 3), ("german", 3, 1, 5)]), DDL)
    sample = compare.stratified_sample(df, 80).collect()
    assert {r.text_language for r in sample} == {"english", "zulu", "german"}
    assert 60 <= len(sample) <= 100
    sizes = {}
    for r in sample:
        sizes[r.review_id] = sizes.get(r.review_id, 0) + 1
    assert set(sizes.values()) == {3, 4, 5}
    made_up = compare.sample_composition(compare.stratified_sample(df, 80)).collect()
    assert {r.text_language: r.sentences for r in made_up}["zulu"] == 3


def test_sample_is_repeatable_and_keeps_unknown_languages(spark):
    df = spark.createDataFrame(sentence_rows([("english", 5, 100, 3), (None, 5, 2, 2)]), DDL)
    first = sorted(map(str, compare.stratified_sample(df, 60).collect()))
    assert first == sorted(map(str, compare.stratified_sample(df.repartition(7), 60).collect()))
    assert any("text_language=None" in r for r in first)
    assert first != sorted(map(str, compare.stratified_sample(df, 60, seed=7).collect()))


def answers(spark, rows):
    """rows of dicts over a plain answer."""
    plain = {"review_key": "k1", "sentence_index": 0, "frustration": 0.0, "products_mentioned": ["a"], "error": None,
             "latency_ms": 100, "input_tokens": 1000, "output_tokens": 500, "model": "m", "question_set_version": "v",
             "problem_category": "none", "language": "english", "sentiment": "neutral", "recommendation": "none",
             **dict.fromkeys(FLAGS, 0.1)}
    columns = [p.split()[0] for p in ANSWERS_DDL.split(", ")]
    full = [tuple((plain | r).get(c) for c in columns) for r in rows]
    return conform(spark.createDataFrame(full, ANSWERS_DDL), ANSWERS_DDL)


def test_agreement(spark):
    a = answers(spark, [{"problem_category": "safety", "frustration": 3.0, "churn_risk": 0.9},
                        {"sentence_index": 1, "products_mentioned": ["a", "b"]}])
    b = answers(spark, [{"problem_category": "safety", "frustration": 1.5, "churn_risk": 0.6},
                        {"sentence_index": 1, "problem_category": "price_value", "frustration": 0.5,
                         "products_mentioned": ["b", "a"]}])
    rows = {r.question: r.agreement for r in compare.agreement(a, b).collect()}
    assert len(rows) == 1 + len(CHOICES) + len(FLAGS) + 1
    assert (rows["problem_category"], rows["frustration (within 1)"], rows["churn_risk"]) == (0.5, 0.5, 1.0)
    assert rows["products_mentioned"] == 1.0
    failed = b.withColumn("error", F.when(F.col("sentence_index") == 1, "busy"))
    assert {r.sentences for r in compare.agreement(a, failed).collect()} == {1}
    sentences = spark.createDataFrame([("R1", "k1", i, "english", 5, "Kettle", f"s{i}") for i in (0, 1)], DDL)
    shown = compare.disagreements(a, b, sentences, "problem_category", names=("one", "two")).collect()
    assert [(r.sentence, r.one, r.two) for r in shown] == [("s1", "none", "price_value")]


def test_accuracy(spark):
    results = answers(spark, [
        {"problem_category": "performance", "frustration": 3.0},
        {"sentence_index": 1, "problem_category": "safety", "frustration": 2.0},
        {"review_key": "k2", "problem_category": "assembly", "frustration": 1.0, "language": "other"},
        {"review_key": "k3", "problem_category": "none"}])
    sentences = spark.createDataFrame([("R1", "k1", 0), ("R1", "k1", 1), ("R2", "k2", 0), ("R3", "k3", 0)],
                                      "review_id STRING, review_key STRING, sentence_index INT")
    truth = spark.createDataFrame([("R1", 0.2, "safety", "english"), ("R2", 0.3, "assembly", "zulu")],
                                  "review_id STRING, satisfaction DOUBLE, aspect STRING, language STRING")
    row = compare.accuracy(results, sentences, truth).first()
    assert (row.language, row.issue_found, row.primary_issue, row.unhappy_reviews) == (1.0, 1.0, 0.5, 2)
    # an unhappy review in which nothing was found counts against issue_found, not primary_issue
    more = truth.union(spark.createDataFrame([("R3", 0.1, "safety", "english")], truth.schema))
    row = compare.accuracy(results, sentences, more).first()
    assert (row.issue_found, row.primary_issue, row.unhappy_reviews, row.primary_reviews) == (0.667, 0.5, 3, 2)


def test_speed(spark):
    rows = [{"sentence_index": i, "latency_ms": ms} for i, ms in enumerate((100, 200, 300, 400))]
    results = answers(spark, rows).withColumn("run", F.lit("a"))
    runs = spark.createDataFrame([("a", 2.0, 8)], "run STRING, seconds DOUBLE, concurrency BIGINT")
    row = compare.speed(results, runs, sentences_in_dataset=6000).first()
    assert (row.p50_ms, row.p95_ms, row.sentences_per_s, row.dataset_minutes) == (250.0, 400, 2.0, 50.0)
    assert (row.sentences, row.failed, row.concurrency) == (4, 0, 8)


def test_speed_with_failures_and_ties(spark):
    rng = random.Random(4)
    values = [rng.randrange(100, 140) for _ in range(201)]
    rows = [{"sentence_index": i, "latency_ms": ms} for i, ms in enumerate(values)]
    rows += [{"sentence_index": 500 + i, "latency_ms": 120, "error": "busy"} for i in range(50)]
    runs = spark.createDataFrame([("a", 2.0, 8), ("b", 2.0, 8)], "run STRING, seconds DOUBLE, concurrency BIGINT")
    only_failed = [{"sentence_index": 0, "error": "busy"}]
    results = answers(spark, rows).withColumn("run", F.lit("a")).union(
        answers(spark, only_failed).withColumn("run", F.lit("b")))
    got = {r.classifier: r for r in compare.speed(results, runs, sentences_in_dataset=10).collect()}
    assert (got["a"].sentences, got["a"].failed) == (251, 50)
    assert (got["a"].p50_ms, got["a"].p95_ms) == (statistics.median(values), sorted(values)[round(200 * 0.95)])
    assert (got["b"].failed, got["b"].p50_ms, got["b"].p95_ms) == (1, None, None)


def test_cost(spark):
    results = answers(spark, [{}]).withColumn("run", F.lit("a")).union(answers(spark, [{}]).withColumn("run", F.lit("b")))
    rows = {r.classifier: r for r in compare.cost(results, {"a": (1, 4), "b": (None, None)},
                                                  sentences_per_1000_customers=6000).collect()}
    assert rows["a"].usd_per_sentence == pytest.approx(0.003) and rows["a"].usd_per_1000_customers == 18.0
    assert rows["b"].usd_per_sentence is None and rows["b"].input_tokens == 1000


def test_prompt_tokens_count_a_repeated_sentence_once(spark):
    ddl = ("review_id STRING, review_key STRING, sentence_index INT, sentence_count INT, sentence STRING, "
           "review_text STRING, product_name STRING, product_category STRING")
    one = spark.createDataFrame([("R1", "k", 0, 1, "Hot.", "Hot.", "Kettle", "kitchen")], ddl)
    two = one.union(one.withColumn("review_id", F.lit("R2")))
    counted = compare.prompt_tokens(two).first()
    assert counted.sentences == 1 and tuple(counted) == tuple(compare.prompt_tokens(one).first())
    texts = one.select("review_key", "review_text")
    assert tuple(compare.prompt_tokens(two.drop("review_text"), texts).first()) == tuple(counted)
