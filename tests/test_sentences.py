"""Splitting text into sentences, content keys and loading."""

import hashlib
from datetime import date, datetime

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from feedloom.functions.keys import content_key, product_slug, stable_int
from feedloom.operators.load import LOADED, load_reviews, missing_texts, product_catalogue
from feedloom.operators.sentences import WHITESPACE, sentence_counts, split_sentences

CASES = {
    "three": ("Lid broke!  Thin steel. Going back to my old one.", ["Lid broke!", "Thin steel.", "Going back to my old one."]),
    "run": ("Great?! Holds 5.5 degrees steady.", ["Great?!", "Holds 5.5 degrees steady."]),
    "wide": ("点火器坏了。客服不管！还能用吗？ 不买了。", ["点火器坏了。", "客服不管！", "还能用吗？", "不买了。"]),
    "spaces": ("a　b c. d", ["a b c.", "d"]),
    "lines": ("One.\nTwo.\t\x0bThree", ["One.", "Two.", "Three"]),
    "empty": ("", []),
    "blank": (" \n ", []),
    "open": ("no stop", ["no stop"]),
    "only stops": ("... !!", ["...", "!!"]),
}


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()] + [("null", None)],
                                 "review_id STRING, review_text STRING")


def test_split(spark, reviews):
    got = {}
    for r in split_sentences(reviews).orderBy("review_id", "sentence_index").collect():
        got.setdefault(r.review_id, []).append((r.sentence_index, r.sentence_count, r.sentence))
    expected = {k: [(i, len(s), x) for i, x in enumerate(s)] for k, (_, s) in CASES.items() if s}
    assert got == expected
    assert {r.review_id: r.sentence_count for r in sentence_counts(reviews).collect()} == \
        {k: len(s) for k, (_, s) in CASES.items() if s}


def test_split_needs_no_shuffle_and_runs_once(spark, reviews):
    plan = plan_of(split_sentences(reviews).select("review_id", "sentence"))
    assert "Exchange" not in plan
    assert plan.count("regexp_replace") == 2  # white space and boundaries, each once


def test_white_space_of_any_kind_becomes_one_space(spark):
    texts = ["a b  c\t d", "\n a\u00a0b \u2003 c\u0085d", " a", "a \n", "a\u3000\u3000b. \r\nc", " ", "a\u200bb", "a\x1cb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    got = rows.select("id", F.regexp_replace("t", WHITESPACE, " ").alias("got"),
                      F.regexp_replace("t", r"(?U)\s+", " ").alias("want")).collect()
    assert all(r.got == r.want for r in got) and got[0].got == "a b c d"


def test_a_very_long_review_keeps_every_sentence(spark):
    df = spark.createDataFrame([("x", " ".join(f"S{i}." for i in range(20_000)))], "review_id STRING, review_text STRING")
    assert split_sentences(df).agg(F.count("*"), F.max("sentence_index")).first()[:] == (20_000, 19_999)


def test_keys_match_hashlib(spark):
    pairs = [("Kettle", "Good."), ("Kettle", "好。"), ("Pan é", "")]
    df = spark.createDataFrame(pairs, "p STRING, t STRING")
    rows = df.select("p", "t", content_key("p", "t").alias("k"), stable_int(F.col("p")).alias("n")).collect()
    for r in rows:
        assert r.k == hashlib.sha1(f"{r.p}\x1f{r.t}".encode()).hexdigest()[:12]
        assert int(r.n) == int.from_bytes(hashlib.sha256(r.p.encode()).digest()[:8], "big")


def test_slug(spark):
    df = spark.createDataFrame([("Steel Kettle 22\" (Pro)",), ("__a--b",)], "p STRING")
    assert [r.s for r in df.select(product_slug(F.col("p")).alias("s")).collect()] == ["steel_kettle_22_pro", "a_b"]


def small_tables(spark):
    t = datetime(2025, 3, 1)
    return {
        "customers": spark.createDataFrame([("C1", datetime(2025, 1, 1), date(1990, 1, 1), "male", "Japan")],
                                           "customer_id STRING, signup_at TIMESTAMP_NTZ, date_of_birth DATE, gender STRING, country STRING"),
        "products": spark.createDataFrame([("P1", "Steel Kettle", "kitchen"), ("P2", "Apron", "cloth")],
                                          "product_id STRING, product_name STRING, category STRING"),
        "orders": spark.createDataFrame([("O1", "C1", datetime(2025, 2, 1), 30.0)],
                                        "order_id STRING, customer_id STRING, ordered_at TIMESTAMP_NTZ, order_total DOUBLE"),
        "reviews": spark.createDataFrame([("R1", "C1", "P1", "L1", t, 4, 1), ("R2", "C1", "P2", "L2", t, 2, 1)],
                                         "review_id STRING, customer_id STRING, product_id STRING, order_line_id STRING, "
                                         "reviewed_at TIMESTAMP_NTZ, rating INT, batch_id INT"),
        "review_texts": spark.createDataFrame([("R1", "h", "Fine.", "english", "w", t)],
                                              "review_id STRING, prompt_hash STRING, review_text STRING, language STRING, "
                                              "model STRING, generated_at TIMESTAMP_NTZ"),
    }


def test_load_leaves_out_reviews_without_text(spark):
    tables = small_tables(spark)
    loaded = load_reviews(tables)
    assert loaded.columns == LOADED
    assert [(r.review_id, r.product_category, r.lifetime_revenue, r.tenure_days) for r in loaded.collect()] == \
        [("R1", "kitchen", 30.0, 59.0)]
    assert [r.review_id for r in missing_texts(tables).collect()] == ["R2"]
    assert [r.product_name for r in product_catalogue(tables["products"]).collect()] == ["Apron", "Steel Kettle"]
    with pytest.raises(ValueError, match="review_texts"):
        load_reviews({k: v for k, v in tables.items() if k != "review_texts"})
