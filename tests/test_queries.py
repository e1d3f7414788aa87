"""Every registered query beside its SQL on the smallest data set."""

import os
from functools import cached_property

import pytest

import __spark_entry__ as contract
from pyspark.sql import functions as F

from feedloom.operators import classify
from feedloom.plans import storage_queries
from feedloom.plans.all_queries import REGISTRY
from feedloom.plans.domain import Domain, drawn_answers, drawn_json, lists_read
from feedloom.plans.lexical import NAMES, PROBLEM_CUES
from feedloom.session import materialise
from tests.conftest import plan_of
from tools.check_oracle import rows

duckdb = pytest.importorskip("duckdb")
DATA = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


class StoredDomain(Domain):
    """What most queries start from, computed once and stored, so that not every query splits and scores again."""

    @cached_property
    def loaded(self):
        return materialise(Domain.loaded.func(self), "loaded")

    @cached_property
    def texts(self):
        return materialise(Domain.texts.func(self), "texts")

    @cached_property
    def sentences(self):
        return materialise(Domain.sentences.func(self), "sentences")

    @cached_property
    def reviews_view(self):
        return materialise(Domain.reviews_view.func(self), "reviews_view")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.fixture(scope="module")
def domain(spark):
    return StoredDomain(spark, DATA)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, domain, name):
    found = REGISTRY[name].run(domain) if name in REGISTRY else contract.queries()[name](spark, DATA)
    ours = found.toPandas()
    theirs = con.sql(contract.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_scorer_reads_each_sentence_once(spark):
    d = Domain(spark, DATA)
    scoring = drawn_answers(d.asked, d.products, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert scoring.count("regexp_extract_all") == 1
    for name in ("needs_review", "problems_by_product", "flagged_safety_concern", "explode_answers"):
        assert "regexp_extract_all" not in plan_of(REGISTRY[name].run(d))


def test_answers_without_names_join_no_product_and_equal_the_whole_ones(spark):
    asked = ["problem_category", "frustration", "latency_ms", "error"]
    d, again = Domain(spark, DATA), Domain(spark, DATA)
    assert "Join" not in plan_of(drawn_answers(d.heard, d.products, "b", columns=asked))
    twice = d.products.unionByName(d.products)  # an id that comes twice gives rows of its own, named or not
    assert drawn_answers(d.heard, twice, "b", columns=asked).count() == drawn_answers(d.heard, twice, "b").count()
    for salt, few in zip("ab", d.both_answers(*asked)):
        whole = again.answers(salt).select(few.columns)
        assert few.count() == whole.count() > 0 and few.exceptAll(whole).isEmpty()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_only_what_the_answers_follow_from_is_written(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    whole = ["place", "marks", "product_name"]
    for asked, unread in ((["latency_ms", "error"], whole), (["sentiment", "error"], ["place", "product_name"]),
                          (["products_mentioned"], []), ([], [])):
        rows = d.heard_for(*asked)
        assert [c for c in whole if rows.where(F.col(c).isNotNull()).isEmpty()] == unread
        assert sorted(rows.columns) == sorted(d.heard.columns)
        got = drawn_answers(rows, d.products, "b", columns=asked)
        want = drawn_answers(d.heard, d.products, "b").select(got.columns)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    again = Domain(spark, "/root/testdata/sf0.001")
    again.products = d.products.union(d.products)  # an id that comes twice gives a row for each, found by the place
    assert not again.heard_for("latency_ms").where("place is not null").isEmpty()


def test_drawn_json_says_what_the_answers_say(spark):
    keys = spark.createDataFrame([
        ("k1", 0, "Iron Kettle 1", 'It is "the" product that broke, the worst.'), ("k1", 1, "Iron Kettle 1", "Hm"),
        ("k2", 0, "Lamp & Co 2", "un den de that another those the it this"), ("k2", 1, "Lamp & Co 2", "no cue at all here")],
        "review_key STRING, sentence_index INT, product_name STRING, sentence STRING")
    products = spark.createDataFrame([(1, "Iron Kettle 1"), (2, "Lamp & Co 2")], "product_id BIGINT, product_name STRING")
    flat = classify.flatten_answers(drawn_json(keys, products, "a"), products.select("product_name"))
    want = drawn_answers(keys, products, "a")
    assert sorted(map(str, flat.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # what every sentence is asked is written from columns, not gathered entry by entry
    assert "map_from_entries" not in drawn_json(keys, products, "a")._jdf.queryExecution().optimizedPlan().toString()


def test_only_cues_that_are_asked_for_are_counted(spark):
    assert len(lists_read(("problem_category", "error"))) == len(PROBLEM_CUES)
    assert {n for n, _ in lists_read(("products_mentioned", "sentiment_confidence"))} == {
        "own_mention", "other_mention", "sentiment"}
    assert lists_read(()) == NAMES and not lists_read(("latency_ms",))


def test_long_generated_code_is_not_run_uncompiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_merged_problems_split_the_sentences_once_for_both_runs(spark, monkeypatch):
    written = {}

    def noted(df, name):
        written[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialise(df, name)

    monkeypatch.setattr(storage_queries, "materialise", noted)
    REGISTRY["problems_merged"].run(Domain(spark, DATA))
    assert "posexplode" in written.pop("sentences").lower()
    assert set(written) == {"classified_a", "classified_b"}
    assert not any("posexplode" in plan.lower() for plan in written.values())
