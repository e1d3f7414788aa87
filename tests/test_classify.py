"""Questions, state, what is asked, scoring, flattening, and the answer cache."""

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.fixed_values import CHOICES, FLAGS
from feedloom.operators import classify
from feedloom.plans.all_queries import REGISTRY
from feedloom.plans.domain import Domain
from feedloom.schemas import KEY, RAW_ANSWERS_DDL
from feedloom.sources import caches
from tests.conftest import plan_of

DATA = "/root/testdata/sf0.001"

SENTENCES = ("review_id STRING, review_key STRING, sentence_index INT, sentence_count INT, sentence STRING, "
             "review_text STRING, product_name STRING, product_category STRING, rating INT, country STRING")


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([("Steel Kettle", "kitchen"), ("Camp Stove", "outdoor")],
                                 "product_name STRING, product_category STRING")


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [(r, k, i, 2, s, "Hot. Too hot.", "Steel Kettle", "kitchen", 1, "Canada")
            for r, k in (("R1", "k1"), ("R2", "k1"), ("R3", "k2")) for i, s in ((0, "Hot."), (1, "Too hot."))]
    return spark.createDataFrame(rows, SENTENCES)


def reply(kettle=0.9, stove=0.6, **changes):
    answers = {"frustration": {"score": 2.0, "confidence": 0.8}}
    answers |= {c: {"choice": "other", "confidence": 0.7} for c in CHOICES}
    answers |= {f: {"probability": 0.2} for f in FLAGS}
    answers |= {"mentions__steel_kettle": {"probability": kettle}, "mentions__camp_stove": {"probability": stove}}
    return answers | changes


def raw(spark, answers, error=None):
    body = None if answers is None else json.dumps(answers)
    return spark.createDataFrame([("k1", 0, body, "m", 10, 5, 7, error)], RAW_ANSWERS_DDL)


def test_question_set(catalogue):
    rows = {r.question: r for r in classify.question_set(catalogue).collect()}
    assert len(rows) == 9 + 2
    assert rows["competitor_mention"].instructions.endswith("Our range is: {range}.")
    assert "the Camp Stove (outdoor)?" in rows["mentions__camp_stove"].instructions
    assert len(rows["frustration"].labels) == 5 and len(rows["problem_category"].labels) == 13
    assert {r.version for r in rows.values()} == {"2026-09-18.3"}


def test_the_range_is_a_table_of_any_size(spark, catalogue):
    assert {r.product_name for r in classify.product_range(catalogue).collect()} == {"Steel Kettle", "Camp Stove"}
    many = spark.range(30_000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("product_name"),
                                      F.lit("c").alias("product_category"))
    assert classify.question_set(many).count() == 9 + 30_000 and classify.product_range(many).count() == 30_000


def test_a_very_long_slug_is_matched(spark):
    name = "long " * 2100 + "name"
    one = spark.createDataFrame([(name, "c")], "product_name STRING, product_category STRING")
    slug = one.select(classify.product_slug(F.col("product_name"))).first()[0]
    assert len(slug) > 10_000
    body = json.dumps({f"mentions__{slug}": {"probability": 0.9}})
    raw = spark.createDataFrame([("k1", 0, body, "m", 1, 1, 1, None)], RAW_ANSWERS_DDL)
    assert classify.flatten_answers(raw, one).first().products_mentioned == [name]


def test_state_holds_neither_rating_nor_customer(sentences):
    state = json.loads(classify.with_state(sentences).orderBy("review_id", "sentence_index").first().state)
    assert state["sentence_position"] == "1 of 2"
    assert state["review"] == {"product_reviewed": "Steel Kettle", "product_category": "kitchen", "full_text": "Hot. Too hot."}
    assert set(state) == {"task", "note", "sentence", "sentence_position", "review"}


def test_state_may_join_the_text_late(sentences):
    texts = sentences.select("review_key", "review_text").distinct()
    late = classify.with_state(sentences.drop("review_text"), texts).select("review_id", "sentence_index", "state")
    usual = classify.with_state(sentences).select("review_id", "sentence_index", "state")
    assert sorted(late.collect()) == sorted(usual.collect())


def test_a_late_text_may_be_null_or_without_product(spark):
    rows = [(r, r, 0, 1, 'A "b".', t, p, c) for r, t, p, c in (
        ("R1", "x\n\u00e9", None, None), ("R2", None, None, None), ("R3", None, "p", None), ("R4", "", None, "c"))]
    odd = spark.createDataFrame(rows, SENTENCES.split(", rating")[0])
    late = classify.with_state(odd.drop("review_text"), odd.select("review_key", "review_text"))
    assert sorted(late.select("review_id", "state").collect()) == \
        sorted(classify.with_state(odd).select("review_id", "state").collect())


def test_a_state_is_measured_by_its_parts(spark, sentences):
    odd = spark.createDataFrame(
        [(f"X{i}", f"x{i}", 0, 1, s, text, name, kind, 1, "Canada") for i, (s, text, name, kind) in enumerate([
            ("Hot.", "Hot \"quoted\"\n\u4e0d\u597d \U0001f525", "Steel Kettle", "kitchen"), ("A", None, "Steel Kettle", None),
            ("B", "", None, None), ("C", None, None, None), ("D", "D \\ \t", None, "kitchen")])], SENTENCES)
    rows = sentences.unionByName(odd)
    texts = classify.distinct_reviews(rows.select("review_id", "review_key", "review_text").distinct())
    late = classify.with_state(rows.drop("review_text"), texts, size="size")
    usual = classify.with_state(rows, size="size").select("review_id", "sentence_index", "state", "size")
    assert sorted(late.select(*usual.columns).collect()) == sorted(usual.collect())
    assert all(len(r.state) == r.size for r in late.collect())
    # the size alone has no state made and carries no sentence to the texts
    plan = plan_of(late.select("size"))
    assert "substring(__around" not in plan and "review_text" in plan
    assert not late.where("size IS NULL").count()


def test_no_state_and_no_text_per_sentence_is_shuffled(sentences):
    def peek(row):
        return {"answers": {"state": row["state"]}}
    scorer, texts = classify.per_sentence(peek, model="m"), sentences.select("review_key", "review_text").distinct()
    bare = classify.distinct_sentences(sentences.drop("review_text"))
    late = classify.score_sentences(bare, scorer, columns=[*KEY, "state"], partitions=2, texts=texts)
    early = classify.score_sentences(classify.with_state(bare, texts), scorer, columns=[*KEY, "state"], partitions=2)
    answers = [sorted(df.select(*KEY, "answers_json").collect()) for df in (late, early)]
    assert answers[0] == answers[1] and len(answers[0]) == 4
    above = plan_of(late).split("Exchange")[0]  # nothing is shuffled once the states are made
    assert "state" in above and "Join" in above


def test_the_query_for_distinct_sentences_gathers_no_text(spark):
    gathered = [line for line in plan_of(REGISTRY["distinct_sentences"].run(Domain(spark, DATA))).splitlines() if "min_by" in line]
    assert gathered and not any("review_text" in line or "product_name" in line for line in gathered)


def test_equal_texts_are_asked_once(sentences):
    rows = classify.distinct_sentences(sentences).collect()
    assert sorted((r.review_id, r.review_key, r.sentence_index) for r in rows) == \
        [("R1", "k1", 0), ("R1", "k1", 1), ("R3", "k2", 0), ("R3", "k2", 1)]
    reviews = sentences.select("review_id", "review_key").distinct()
    assert sorted(r.review_id for r in classify.distinct_reviews(reviews).collect()) == ["R1", "R3"]


@pytest.mark.parametrize("stove, expected", [(0.6, ["Camp Stove", "Steel Kettle"]), (0.49, ["Steel Kettle"])])
def test_mentions_follow_the_threshold(spark, catalogue, stove, expected):
    assert classify.flatten_answers(raw(spark, reply(stove=stove)), catalogue).first().products_mentioned == expected


def test_stored_answers_can_be_read_under_another_threshold(spark, catalogue):
    flat = classify.flatten_answers(raw(spark, reply()), catalogue)
    assert classify.rethreshold(flat, catalogue, 0.7).first().products_mentioned == ["Steel Kettle"]
    assert classify.rethreshold(flat, catalogue, 0.95).first().products_mentioned == []


def test_out_of_range_answers_are_clipped(spark, catalogue):
    wild = reply(frustration={"score": 6.0, "confidence": 1.4}, churn_risk={"probability": -0.2})
    row = classify.flatten_answers(raw(spark, wild), catalogue).first()
    assert (row.frustration, row.frustration_confidence, row.churn_risk) == (4.0, 1.0, 0.0)


def test_a_failure_keeps_its_error_and_nothing_else(spark, catalogue):
    row = classify.flatten_answers(raw(spark, None, "TimeoutError: busy"), catalogue).first()
    assert (row.error, row.frustration, row.products_mentioned) == ("TimeoutError: busy", None, None)


def test_explode(spark):
    rows = {r.question: r for r in classify.explode_answers(raw(spark, reply())).collect()}
    assert rows["frustration"].score == 2.0 and rows["sentiment"].choice == "other" and len(rows) == 11


def counting(folder, failing=()):
    """A scorer that leaves one file per call, so calls on executors can be counted."""
    answers = reply()

    def ask(row):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(row["review_key"]))
        if row["review_key"] in failing:
            raise TimeoutError("busy")
        return {"answers": answers, "input_tokens": 10}

    return classify.per_sentence(ask, model="m")


def test_cache_is_reused_and_failures_are_retried(sentences, catalogue, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    count = lambda: len(list(calls.iterdir()))
    run = lambda failing=(): caches.classify_sentences(
        sentences, catalogue, counting(str(calls), failing), columns=KEY, cache_path=path, model="m", partitions=2)
    first = run(failing=("k2",)).collect()
    assert count() == 4 and len(first) == 4
    assert sum(r.error is not None for r in first) == 2
    second = run().collect()
    assert count() == 6 and len(second) == 4 and all(r.error is None for r in second)
    assert len(run().collect()) == 4 and count() == 6


def test_models_share_the_cache(spark, sentences, catalogue, tmp_path):
    path = str(tmp_path / "cache")
    for model in ("m", "n"):
        flat = classify.flatten_answers(raw(spark, reply()), catalogue).withColumn("model", F.lit(model))
        caches.append_answers(flat, path)
        caches.append_answers(flat.withColumn("question_set_version", F.lit("old")), path)
    assert caches.read_answers(spark, path, model="m").count() == 1
    assert caches.read_answers(spark, path, model="n").count() == 1
    assert spark.read.parquet(path).count() == 4  # other versions stay
    assert classify.cache_misses(sentences, caches.read_answers(spark, path, model="x")).count() == 4
    assert classify.cache_misses(sentences, caches.read_answers(spark, path, model="m")).count() == 3


def test_output_is_limited_to_the_requested_keys(spark, sentences, catalogue, tmp_path):
    path = str(tmp_path / "cache")
    (tmp_path / "calls").mkdir()
    scorer = counting(str(tmp_path / "calls"))
    caches.classify_sentences(sentences, catalogue, scorer, columns=KEY, cache_path=path)
    only = caches.classify_sentences(sentences.where("review_key = 'k2'"), catalogue, scorer, columns=KEY, cache_path=path)
    assert {r.review_key for r in only.collect()} == {"k2"}


def test_answers_come_back_to_every_copy(spark, sentences, catalogue):
    flat = classify.flatten_answers(raw(spark, reply()), catalogue)
    joined = classify.attach_answers(sentences, flat).where("model IS NOT NULL")
    assert sorted(r.review_id for r in joined.collect()) == ["R1", "R2"]
    usage = classify.usage_summary(flat).first()
    assert (usage.models, usage.answers, usage.input_tokens, usage.errors) == ("m", 1, 10, 0)


def test_scorer_sees_only_the_columns_it_names(sentences):
    def peek(row):
        return {"answers": {"frustration": {"score": float(len(row)), "confidence": 1.0}}}
    scored = classify.score_sentences(sentences, classify.per_sentence(peek, model="m"), columns=KEY, partitions=2)
    assert {json.loads(r.answers_json)["frustration"]["score"] for r in scored.collect()} == {2.0}


def test_sentences_are_not_handed_to_the_pool_one_by_one(monkeypatch):
    handed, flying, most = [], [], []

    class Pool(ThreadPoolExecutor):
        def submit(self, *args, **kwargs):
            handed.append(args)
            return super().submit(*args, **kwargs)

    def slow(row):
        flying.append(row)
        most.append(len(flying))
        time.sleep(0.02)
        flying.remove(row)
        if row["sentence_index"] == 5:
            raise TimeoutError("busy")
        return {"answers": {"n": row["sentence_index"]}}

    monkeypatch.setattr(classify, "ThreadPoolExecutor", Pool)
    batches = [pd.DataFrame({"review_key": [f"k{k}" for k in range(n)], "sentence_index": range(n)}) for n in (40, 0, 3)]
    out = list(classify.per_sentence(slow, model="m", concurrency=4)(iter(batches)))
    assert len(handed) <= 3 * 4 and max(most) == 4  # a thread takes the next itself; as many calls in flight as before
    assert [list(o.review_key) for o in out] == [list(b.review_key) for b in batches]
    assert [None if pd.isna(a) else json.loads(a)["n"] for a in out[0].answers_json] == [*range(5), None, *range(6, 40)]
    assert out[0].error[5] == "TimeoutError: busy" and out[0].error.isna().sum() == 39 and (out[0].latency_ms >= 20).all()


def test_a_text_goes_to_the_scorer_once_per_review(spark, sentences, monkeypatch):
    """What crosses to Python holds a review's text once; the scorer sees the whole states, a bounded number at a time."""
    seen = classify.with_state
    monkeypatch.setattr(classify, "with_states", lambda scorer, columns: lambda batches: (
        pd.DataFrame({"review_key": b.review_key, "sentence_index": b.sentence_index, "answers_json": b["__state_rest"], "model": "m",
                      "input_tokens": b["__state_opening"].str.len(), "output_tokens": 0, "latency_ms": 0, "error": None})
        for b in batches))
    many = spark.range(300).select(
        F.format_string("k%d", F.col("id") % 3).alias("review_key"), F.floor(F.col("id") / 3).cast("int").alias("sentence_index"),
        F.lit(100).alias("sentence_count"), F.lit("It leaks.").alias("sentence"), F.lit("Kettle").alias("product_name"),
        F.lit(None).cast("string").alias("product_category"))
    texts = spark.createDataFrame([(f"k{k}", "x" * 5000) for k in range(3)] + [(None, "y")], "review_key STRING, review_text STRING")
    crossed = classify.score_sentences(many, None, columns=[*KEY, "state"], partitions=2, texts=texts).collect()
    assert len(crossed) == 300 and sum(len(r.answers_json or "") for r in crossed) < 3 * 5100
    monkeypatch.undo()

    def given(batches):
        for b in batches:
            assert list(b.columns) == ["state", *KEY] and list(b.index) == list(range(len(b)))
            yield pd.DataFrame({"review_key": b.review_key, "sentence_index": b.sentence_index, "answers_json": b.state,
                                "model": str(len(b)), "input_tokens": 0, "output_tokens": 0, "latency_ms": 0, "error": None})

    chars = 20_000
    bounded = classify.with_states(given, ["state", *KEY])
    monkeypatch.setattr(classify, "STATE_CHARS", chars)
    rows = pd.DataFrame({"review_key": ["k"] * 20, "sentence_index": range(20), "__state_opening": "{", "__state_rest": ["x" * 6000] + [None] * 19})
    assert [len(b) for b in bounded(iter([rows, rows.iloc[1:]]))] == [4] * 5 + [4, 4, 4, 4, 3]
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="without its text"):
        list(classify.with_states(given, ["state", *KEY])(iter([rows.iloc[1:]])))
    got = classify.score_sentences(many, given, columns=["state", *KEY], partitions=2, texts=texts.unionByName(texts)).collect()
    want = seen(many, texts.unionByName(texts)).collect()
    assert sorted((r.review_key, r.sentence_index, r.answers_json) for r in got) == sorted(
        (r.review_key, r.sentence_index, r.state) for r in want) and len(got) == 600
