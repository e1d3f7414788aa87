"""Answers as VARIANT beside answers as JSON text."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import answer_variants, classify
from feedloom.schemas import RAW_ANSWERS_DDL
from feedloom.session import materialise
from feedloom.sources import caches
from tests.conftest import plan_of

CATALOGUE = [("Iron Kettle",), ("Desk Lamp",), ("iron kettle!",)]


def answer_text(**more):
    return json.dumps({"frustration": {"score": 5.5, "confidence": 1.2}, "sentiment": {"choice": "negative", "confidence": 0.4},
                       "churn_risk": {"probability": -0.1}, "mentions__iron_kettle": {"probability": 0.7},
                       "mentions__desk_lamp": {"probability": 0.5}, **more})


ROWS = [
    ("k1", 0, answer_text(), "m", 1, 2, 30, None),
    ("k1", 1, answer_text(mentions__iron_kettle={"probability": None}, sentiment=None), "m", 1, 2, 30, None),
    ("k2", 0, None, "m", None, None, 30, "TimeoutError: busy"),
    ("k3", 0, "{}", "m", 1, 1, 1, None),
    ("k4", 0, "no json", "m", 1, 1, 1, None),
    ("k5", 0, "", "m", 1, 1, 1, None),
    ("k6", 0, answer_text(note={"confidence": 0.5, "why": ["a", {"b": 1}]}), None, None, None, None, None),
    ("k7", 0, "[1, 2]", "m", 1, 1, 1, None),
    ("k8", 0, answer_text(suggestion={"probability": 1}, competitor_mention={"score": "high"}), "m", 1, 1, 1, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW_ANSWERS_DDL)


@pytest.fixture(scope="module")
def stored(raw):
    return materialise(answer_variants.with_variant(raw), "variants")


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "product_name STRING")


def found(df):
    return sorted(map(str, (row.asDict() for row in df.collect())))


def test_exploded_rows_are_the_same(raw, stored):
    # k8's "high" is no number: null on both sides
    assert found(answer_variants.explode_answers(stored)) == found(classify.explode_answers(raw))


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.7, 1.0])
def test_flat_rows_are_the_same(raw, stored, catalogue, threshold):
    flat = classify.flatten_answers(raw, catalogue, threshold).drop("answers_json")
    ours = answer_variants.flatten_answers(stored, catalogue, threshold)
    assert found(ours.select(*flat.columns)) == found(flat)
    again = answer_variants.rethreshold(answer_variants.flatten_answers(stored, catalogue, 0.9), catalogue, threshold)
    assert found(again.select(*flat.columns)) == found(flat)


def test_nothing_is_parsed_where_it_is_read(stored, catalogue):
    for read in (answer_variants.explode_answers(stored), answer_variants.rethreshold(stored, catalogue, 0.5),
                 answer_variants.flatten_answers(stored, catalogue)):
        assert "parse_json" not in plan_of(read).lower() and "from_json" not in plan_of(read).lower()


def test_all_parts_are_taken_in_one_walk_and_mentions_alone_are_exploded(stored, catalogue):
    assert "variant_get(answer#" not in plan_of(answer_variants.explode_answers(stored))
    assert "startswith" in plan_of(answer_variants.mentioned_products(stored, catalogue)).lower().split("generate ")[-1]


def test_stated_differences(spark):
    odd = [("k1", 0, '{"frustration": {"score": "2.5"}}', "m", 1, 1, 1, None),
           ("k2", 0, '{"suggestion": {"probability": 0.1}, "suggestion": {"probability": 0.2}}', "m", 1, 1, 1, None)]
    rows = answer_variants.explode_answers(answer_variants.with_variant(spark.createDataFrame(odd, RAW_ANSWERS_DDL)))
    assert [(r.review_key, r.score) for r in rows.collect()] == [("k1", 2.5)]


def test_stored_once_per_key_and_failures_not_at_all(spark, raw, tmp_path):
    path = str(tmp_path / "answers")
    assert caches.read_variants(spark, path).count() == 0
    caches.append_variants(raw.where("model IS NOT NULL"), path)
    caches.append_variants(raw.where("review_key = 'k1'").withColumn("latency_ms", F.lit(5).cast("bigint")), path)
    caches.append_variants(raw.where("review_key = 'k3'"), path, version="older")
    kept = caches.read_variants(spark, path, model="m")
    assert sorted((r.review_key, r.sentence_index, r.latency_ms) for r in kept.collect()) == [
        ("k1", 0, 5), ("k1", 1, 5), ("k3", 0, 1), ("k4", 0, 1), ("k5", 0, 1), ("k7", 0, 1), ("k8", 0, 1)]
    assert caches.read_variants(spark, path, model="other").count() == 0
    again = answer_variants.explode_answers(kept.where("review_key = 'k1'"))
    assert found(again) == found(classify.explode_answers(raw.where("review_key = 'k1'")))


def test_no_rows(spark, catalogue):
    none = answer_variants.with_variant(spark.createDataFrame([], RAW_ANSWERS_DDL))
    assert answer_variants.explode_answers(none).count() == 0
    assert answer_variants.flatten_answers(none, catalogue).count() == 0
