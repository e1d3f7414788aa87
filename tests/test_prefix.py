"""Sliced totals and exact quantiles against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from feedloom.operators import quantiles
from feedloom.operators.prefix import earlier, hash_slice
from feedloom.operators.quantiles import exact_quantile, quantiles_of_counts


@pytest.mark.parametrize("width, busy", [(1, 0), (7, 0), (1000, 0), (7, 100), (7, 10**6)])
def test_totals_do_not_depend_on_the_slices(spark, width, busy):
    # one key holds a third of the rows
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i, rng.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "k STRING, t INT, v BIGINT").withColumn("s", F.floor(F.col("t") / width))
    got = {(r.k, r.t): (r.v_before, r.t_before) for r in
           earlier(df, by=["k"], slice_by="s", order=[F.col("t")], sums=["v"], maxima=["t"],
                   busy_rows=busy).collect()}
    for k, t, _ in rows:
        past = [(u, v) for kk, u, v in rows if kk == k and u < t]
        assert got[k, t] == (sum(v for _, v in past), max((u for u, _ in past), default=None))


def test_fractions_add_up_the_same_in_slices(spark):
    rng = random.Random(8)
    rows = [("k", t, round(rng.uniform(0, 1e6), 2)) for t in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, t INT, v DOUBLE").withColumn("s", F.floor(F.col("t") / 50))
    run = lambda busy: {r.t: r.v_before for r in earlier(
        df, by=["k"], slice_by="s", order=[F.col("t")], sums=["v"], busy_rows=busy).collect()}
    assert run(0) == run(10 ** 9)


def test_one_sequence_over_everything(spark):
    df = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("h"), F.lit(1).alias("one"))
    sliced = df.withColumn("s", hash_slice(F.col("h"), 1))
    whole = sliced.withColumn("k", F.lit(0))
    ranked = earlier(whole, by=["k"], slice_by="s", order=[F.col("h")], sums=["one"], busy_rows=0).orderBy("h").collect()
    assert [r.one_before for r in ranked] == list(range(1000))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("n", [1, 2, 999, 5000])
def test_exact_quantile_equals_sorting(spark, monkeypatch, q, n):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 100), 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    at = (n - 1) * q
    ordered = sorted(values)
    low, high = ordered[int(at)], ordered[min(int(at) + 1, n - 1)]
    expected = low + (high - low) * (at - int(at))
    assert exact_quantile(df, "v", q).first().value == pytest.approx(expected)
    monkeypatch.setattr(quantiles, "RANKED", 20)  # so that the range is narrowed several times
    monkeypatch.setattr(quantiles, "CUTS", 5)
    assert exact_quantile(df, "v", q).first().value == pytest.approx(expected)


def test_quantile_with_a_third_of_equal_values(spark):
    values = [5.0] * 500 + [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert exact_quantile(df, "v").first().value == statistics.median(values)


def test_quantiles_of_counts(spark):
    df = spark.createDataFrame([("a", v) for v in (100, 200, 300, 400)] + [("b", 7)], "run STRING, ms BIGINT")
    got = {r.run: r.p50 for r in quantiles_of_counts(df, ["run"], "ms", {"p50": 0.5}).collect()}
    assert got == {"a": 250.0, "b": 7.0}
