"""Briefs, prompts, text cache, estimates, and the profile formulas."""

import hashlib
import random
import re
from collections import Counter
from datetime import date, datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from feedloom.fixed_values import WRITER_SYSTEM
from feedloom.functions import profile as formulas
from feedloom.operators import profile, texts
from feedloom.sources import caches
from tests.conftest import plan_of

BRIEF = ("R0000000001", "Tongs", "accessories", "Long tongs.", 2, 0.2, "build_quality", "german")
DDL = ("review_id STRING, product_name STRING, product_category STRING, product_description STRING, rating INT, "
       "satisfaction DOUBLE, aspect STRING, language STRING")


@pytest.fixture
def briefs(spark):
    return spark.createDataFrame([BRIEF], DDL)


def test_prompt(briefs):
    row = texts.with_prompt(briefs, "w").first()
    assert "Write it in German." in row.prompt and "2 of 5." in row.prompt and "Focus mainly on: build quality." in row.prompt
    assert row.sentences == 2 + int.from_bytes(hashlib.sha256(BRIEF[0].encode()).digest()[:8], "big") % 6
    assert row.prompt_hash == hashlib.sha256(f"w\x1f{WRITER_SYSTEM}\x1f{row.prompt}".encode()).hexdigest()[:16]
    assert texts.with_prompt(briefs, "other").first().prompt_hash != row.prompt_hash


def test_an_unknown_language_is_named_as_it_is(briefs):
    assert "Write it in welsh." in texts.with_prompt(briefs.withColumn("language", F.lit("welsh")), "w").first().prompt


@pytest.mark.parametrize("satisfaction, start", [(0.1, "furious"), (0.15, "clearly"), (0.35, "a bit"), (0.5, "mostly"),
                                                 (0.65, "pleased"), (0.85, "delighted")])
def test_feelings(spark, satisfaction, start):
    assert spark.range(1).select(texts.feeling(F.lit(satisfaction)).alias("f")).first().f.startswith(start)


def test_briefs_need_truth_and_product(spark):
    reviews = spark.createDataFrame([("R1", "P1", 2), ("R2", "P1", 3)], "review_id STRING, product_id STRING, rating INT")
    truth = spark.createDataFrame([("R1", 0.2, "safety", "german")],
                                  "review_id STRING, satisfaction DOUBLE, aspect STRING, language STRING")
    products = spark.createDataFrame([("P1", "Tongs", "accessories", "d")],
                                     "product_id STRING, product_name STRING, category STRING, description STRING")
    assert [r.review_id for r in texts.review_briefs(reviews, truth, products).collect()] == ["R1"]
    none = spark.createDataFrame([("R1",)], "review_id STRING")
    assert texts.text_backlog(reviews, none, truth, products).count() == 0


def test_text_cache(spark, briefs, tmp_path):
    path = str(tmp_path / "texts")
    two = briefs.union(briefs.withColumn("review_id", F.lit("R0000000002")))

    def write(row):
        if row["review_id"].endswith("2") and row["product_name"] == "Tongs":
            raise TimeoutError("busy")
        return "A text."

    def run(model):
        prompted = texts.with_prompt(two, model)
        todo = texts.texts_to_write(prompted, caches.read_texts(spark, path))
        asked = todo.count()
        caches.append_texts(texts.write_texts(todo, write, model=model, partitions=2), path)
        return asked, texts.cached_texts(prompted, caches.read_texts(spark, path)).count()

    assert run("w") == (2, 1)
    assert run("w") == (1, 1)  # only the failure is asked again
    assert run("other") == (2, 1)  # another writer is another prompt
    assert caches.read_texts(spark, path).count() == 2  # the first writer's text stays


def test_estimate(spark, briefs):
    ten = briefs.crossJoin(spark.range(10)).withColumn("review_id", F.format_string("R%010d", "id"))
    sentences = sum(r.n for r in ten.select(texts.brief_length(F.col("review_id")).alias("n")).collect())
    row = texts.batch_estimate(ten, usd_per_million_input=1.0, usd_per_million_output=2.0).first()
    assert (row.reviews, row.sentences, row.classifier_tokens) == (10, sentences, sentences * 2750)
    assert row.classifier_usd == pytest.approx(sentences * 2750 / 1e6 * 0.042)
    assert row.writer_usd == pytest.approx(row.writer_input_tokens / 1e6 + 2 * row.writer_output_tokens / 1e6)
    assert texts.batch_estimate(ten).first().writer_usd is None
    assert texts.batch_estimate(ten.where("false")).first().sentences == 0


def test_propensity(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.25, 0.5, 0.75, 1.0)], "s DOUBLE")
    p = [r.p for r in df.select(formulas.review_probability(
        F.col("s"), base=0.05, extremity=0.4, sharpness=2.0).alias("p")).collect()]
    assert p == pytest.approx([0.45, 0.15, 0.05, 0.15, 0.45])
    with pytest.raises(ValueError):
        formulas.review_probability(F.lit(0.5), base=0.9, extremity=0.4)
    with pytest.raises(ValueError):
        formulas.review_probability(F.lit(0.5), sharpness=0)


def test_rating(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.3, 0.375, 0.5, 0.8, 1.0)], "s DOUBLE")
    stars = [r.r for r in df.select(formulas.expected_rating(F.col("s"), F.lit(0.0)).alias("r")).collect()]
    assert stars == sorted(stars) and stars[0] == 1 and stars[-1] == 5
    assert stars[2] == 2  # 2.5 rounds to the even star
    wild = df.select(formulas.expected_rating(F.col("s"), F.lit(9.0)).alias("r")).collect()
    assert max(r.r for r in wild) == 5


def test_seasonality(spark):
    days = {"july": datetime(2025, 7, 15), "january": datetime(2025, 1, 15), "peak": datetime(2025, 11, 28),
            "early": datetime(2025, 11, 5)}
    df = spark.createDataFrame(list(days.items()), "name STRING, t TIMESTAMP_NTZ")
    north = {r.name: r.s for r in df.select("name", formulas.seasonality_index("t", F.lit(False)).alias("s")).collect()}
    south = {r.name: r.s for r in df.select("name", formulas.seasonality_index("t", F.lit(True)).alias("s")).collect()}
    assert north["july"] > north["january"] and south["january"] > south["july"]
    assert north["peak"] > north["early"]
    assert max([*north.values(), *south.values()]) <= formulas.peak_seasonality()


@pytest.fixture(scope="module")
def shop(spark):
    orders = [(f"O{i}", f"C{i % 4}", datetime(2025, 1 + i % 12, 1), 1.0) for i in range(24)]
    lines = [(f"L{i}", f"O{i}", "grill" if i % 4 < 2 else "salt") for i in range(24)] + [("L99", "O0", "cover")]
    return (spark.createDataFrame(orders, "order_id STRING, customer_id STRING, ordered_at TIMESTAMP_NTZ, order_total DOUBLE"),
            spark.createDataFrame(lines, "order_line_id STRING, order_id STRING, product_id STRING"),
            spark.createDataFrame([("grill", date(2025, 3, 1)), ("salt", date(2020, 1, 1)), ("cover", date(2020, 1, 1))],
                                  "product_id STRING, launched_on DATE"))


def test_profiles(spark, shop):
    orders, lines, products = shop
    lift = profile.affinity_lift(orders, lines, products, F.col("product_id") == "grill", F.col("product_id") == "cover").first()
    assert (lift.customers, lift.buyers, lift.also_buyers, lift.both, lift.rate, lift.lift) == (4, 2, 1, 1, 0.5, 2.0)
    assert profile.repeat_purchase(orders, lines, ["grill"]).first().median_orders == 6.0
    early = profile.sold_before_launch(orders, lines, products)
    assert early.count() == 4 and {r.product_id for r in early.collect()} == {"grill"}
    customers = spark.createDataFrame([(f"C{i}", "South" if i == 0 else "North") for i in range(4)], "customer_id STRING, country STRING")
    shares = profile.monthly_share(orders, customers, ["South"], since="2025-01-01", until="2026-01-01").collect()
    assert sum(r.orders for r in shares) == 24
    assert sum(r.share for r in shares if r.southern) == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize("block_items", [2, 256])
def test_affinity_of_all_pairs(spark, block_items):
    pick = random.Random(5)
    baskets = {c: {f"P{pick.randrange(14):02}" for _ in range(pick.randrange(1, 12))} for c in range(30)}
    baskets[30] = {f"P{k:02}" for k in range(14)} | {f"only{k}" for k in range(20)}  # a busy one
    orders = [(f"O{c}", c) for c in baskets] + [("none", 99)]
    lines = [(f"O{c}", item) for c, items in baskets.items() for item in items] * 2 + [("O1", None), ("gone", "P01"), (None, "P02")]
    orders = spark.createDataFrame(orders, "order_id STRING, customer_id LONG")
    lines = spark.createDataFrame(lines, "order_id STRING, product_id STRING")
    both = Counter(pair for items in baskets.values() for pair in combinations(sorted(items), 2))
    buyers = Counter(item for items in baskets.values() for item in items)
    want = {(a, b): (n, buyers[a], buyers[b], 32, round(n * 32 / (buyers[a] * buyers[b]), 4))
            for (a, b), n in both.items() if n >= 6}
    rows = profile.affinity_pairs(orders, lines, least=6, block_items=block_items).collect()
    assert len(rows) == len(want) > 20
    assert {(r.product_a, r.product_b): (r.both, r.buyers_a, r.buyers_b, r.customers, r.lift) for r in rows} == want
    assert profile.affinity_pairs(orders, lines.limit(0), least=1).collect() == []


def test_tasks_for_pairs_grow_with_the_pairs(spark):
    customers, items = 40, 20  # 40 * 190 pairs
    orders = spark.createDataFrame([(f"O{c}", c) for c in range(customers)], "order_id STRING, customer_id LONG")
    lines = spark.createDataFrame([(f"O{c}", f"P{k:02}") for c in range(customers) for k in range(items)],
                                  "order_id STRING, product_id STRING")
    few, many = (profile.affinity_pairs(orders, lines, least=2, task_pairs=n) for n in (10 ** 6, 100))
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 190
    assert {r.both for r in many.collect()} == {customers}
    for key in ("customer_id", "product_a"):
        assert re.search(rf"hashpartitioning\({key}[^)]*, 76\)", plan_of(many)), key
