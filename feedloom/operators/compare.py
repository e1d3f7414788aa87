"""Compare two scorers on the same sentences: sample, agreement, accuracy, speed and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import CHOICES, EXPECTED_LANGUAGE, FLAGS, YES_THRESHOLD
from feedloom.functions.keys import order_hash
from feedloom.operators.classify import distinct_sentences, with_state
from feedloom.operators.prefix import earlier, hash_slice
from feedloom.schemas import KEY


def stratified_sample(sentences: DataFrame, target: int = 300, *, by: Sequence[str] = ("text_language", "rating"),
                      seed: int = 42) -> DataFrame:
    """All sentences of a sample of reviews, stratified, about `target` sentences and at least a review per stratum.

    Reviews are drawn in hash order, so the sample is the same on any partitioning. A stratum is cut by
    hash into even slices to rank it, so one that holds most reviews is not sorted in one task. Pass a
    stored table: it is read several times.
    """
    reviews = sentences.groupBy("review_id", F.struct(*by).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    strata = reviews.groupBy("stratum").agg(F.sum("n").alias("total"), F.avg("n").alias("mean"))
    share = F.lit(target) / F.sum("total").over(Window.partitionBy())  # one row per stratum
    quotas = strata.select("stratum", F.greatest(F.floor(F.col("total") * share / F.col("mean")), F.lit(1)).alias("quota"))
    hashed = reviews.select("review_id", "stratum", order_hash("review_id", seed).alias("__hash"), F.lit(1).alias("__one")) \
        .withColumn("__slice", hash_slice(F.col("__hash")))
    ranked = earlier(hashed, by=["stratum"], slice_by="__slice", order=[F.col("__hash")], sums=["__one"])
    picked = ranked.join(quotas, "stratum").where(F.col("__one_before") < F.col("quota")).select("review_id")
    return sentences.join(picked, "review_id", "left_semi")


def sample_composition(sample: DataFrame) -> DataFrame:
    """Reviews and sentences of a sample per language."""
    return sample.groupBy("text_language").agg(F.countDistinct("review_id").alias("reviews"),
                                               F.count(F.lit(1)).alias("sentences"))


ASKED = ["frustration", *CHOICES, *FLAGS, "products_mentioned"]


def paired(a: DataFrame, b: DataFrame, asked: Sequence[str] = ASKED) -> DataFrame:
    """Keys both answered without error with what they were asked; the second run's columns end in `_b`."""
    ok = F.col("error").isNull()
    second = b.where(ok).select(*KEY, *[F.col(c).alias(f"{c}_b") for c in asked])
    return a.where(ok).select(*KEY, *asked).join(second, KEY)


def agreement(a: DataFrame, b: DataFrame, threshold: float = YES_THRESHOLD) -> DataFrame:
    """(question, agreement, sentences): how often two runs agree, from one aggregate."""
    same: dict[str, Column] = {"frustration (within 1)": F.abs(F.col("frustration") - F.col("frustration_b")) <= 1}
    same |= {c: F.col(c) == F.col(f"{c}_b") for c in CHOICES}
    same |= {f: (F.col(f) >= threshold) == (F.col(f"{f}_b") >= threshold) for f in FLAGS}
    same["products_mentioned"] = F.array_sort("products_mentioned") == F.array_sort("products_mentioned_b")
    one = paired(a, b).agg(F.count(F.lit(1)).alias("sentences"),
                           *[F.avg(c.cast("int")).alias(str(i)) for i, c in enumerate(same.values())])
    return one.select("sentences", F.inline(F.array(*[
        F.struct(F.lit(q).alias("question"), F.round(F.col(str(i)), 3).alias("agreement"))
        for i, q in enumerate(same)]))).select("question", "agreement", "sentences")


def disagreements(a: DataFrame, b: DataFrame, sentences: DataFrame, question: str, *,
                  names: tuple[str, str] = ("a", "b"), n: int = 5) -> DataFrame:
    """The first n sentences, by key, that two runs labelled differently."""
    differ = paired(a, b, [question]).where(F.col(question) != F.col(f"{question}_b")) \
        .select(*KEY, F.col(question).alias(names[0]), F.col(f"{question}_b").alias(names[1]))
    shown = sentences.select(*KEY, "review_id", "product_name", "sentence")
    return differ.join(shown, KEY).orderBy(*KEY, "review_id").limit(n) \
        .select("product_name", "sentence", *names)


def accuracy(results: DataFrame, sentences: DataFrame, truth: DataFrame) -> DataFrame:
    """One row scoring a run against what each review was meant to say.

    `primary_issue` leaves out unhappy reviews in which no problem was found; `primary_reviews` is how
    many it is taken over.
    """
    expected = F.col("written")
    for written, heard in EXPECTED_LANGUAGE.items():
        expected = F.when(F.col("written") == written, heard).otherwise(expected)
    heard = results.where(F.col("error").isNull()).select(*KEY, "language", "problem_category", "frustration")
    meant = truth.select("review_id", "satisfaction", "aspect", F.col("language").alias("written"))
    rows = sentences.select(*KEY, "review_id").join(heard, KEY).join(meant, "review_id")
    right = F.col("language") == expected
    problem = F.when(F.col("problem_category") != "none", F.col("problem_category"))
    per_review = rows.groupBy("review_id").agg(
        F.count_if(right).alias("hits"), F.count(right).alias("heard"),
        F.any_value("satisfaction").alias("satisfaction"), F.any_value("aspect").alias("aspect"),
        F.coalesce(F.bool_or(problem == F.col("aspect")), F.lit(False)).alias("found"),
        F.max_by(problem, F.when(problem.isNotNull(), F.struct("frustration", -F.col("sentence_index")))).alias("primary"))
    unhappy = F.col("satisfaction") < 0.5
    primary = F.when(unhappy, (F.col("primary") == F.col("aspect")).cast("int"))
    return per_review.agg(
        F.round(F.try_divide(F.sum("hits"), F.sum("heard")), 3).alias("language"),
        F.round(F.avg(F.when(unhappy, F.col("found").cast("int"))), 3).alias("issue_found"),
        F.round(F.avg(primary), 3).alias("primary_issue"),
        F.count_if(unhappy).alias("unhappy_reviews"), F.count(primary).alias("primary_reviews"))


def speed(results: DataFrame, runs: DataFrame, *, sentences_in_dataset: int | Column) -> DataFrame:
    """Per run: latency, throughput and the time the whole dataset would take.

    `results` carries a `run` column; `runs` has one row (run, seconds, concurrency) per run. The 95th
    percentile is the nearest element, the median interpolates. Results are read once: everything
    follows from how often each millisecond occurs, of which a run has few.
    """
    failed = F.col("error").isNotNull()
    histogram = results.groupBy("run", "latency_ms", failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    counts = F.when(~F.col("failed") & F.col("latency_ms").isNotNull(), F.col("n")).otherwise(0)
    upto = Window.partitionBy("run").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.withColumn("ok", counts).select(
        "*", F.sum("ok").over(upto).alias("upto"), F.sum("ok").over(Window.partitionBy("run")).alias("all"))
    reaches = (F.col("ok") > 0) & (F.col("upto") > F.round((F.col("all") - 1) * 0.95))
    measured = ranked.groupBy("run").agg(
        F.sum("n").alias("sentences"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("failed"),
        F.percentile("latency_ms", 0.5, F.col("ok")).alias("p50_ms"),
        F.min(F.when(reaches, F.col("latency_ms"))).alias("p95_ms"))
    rate = F.col("sentences") / F.col("seconds")
    whole = F.lit(sentences_in_dataset) if isinstance(sentences_in_dataset, int) else sentences_in_dataset
    return runs.join(measured, "run").select(
        F.col("run").alias("classifier"), "sentences", "failed", "p50_ms", "p95_ms", "concurrency",
        F.round(rate, 2).alias("sentences_per_s"), F.round(whole / rate / 60, 1).alias("dataset_minutes"))


def cost(results: DataFrame, prices: dict[str, tuple[float | None, float | None]], *,
         sentences_per_1000_customers: int | Column) -> DataFrame:
    """Per run: tokens and dollars per sentence. `prices` gives USD per million (input, output) tokens."""
    rows = [(run, None if i is None else float(i), None if o is None else float(o)) for run, (i, o) in prices.items()]
    priced = results.sparkSession.createDataFrame(rows, "run STRING, price_in DOUBLE, price_out DOUBLE")
    means = results.where(F.col("error").isNull()).groupBy("run").agg(
        F.avg("input_tokens").alias("tokens_in"), F.avg("output_tokens").alias("tokens_out"))
    out = F.coalesce("tokens_out", F.lit(0.0))
    usd = (F.col("tokens_in") * F.col("price_in") + out * F.coalesce("price_out", F.lit(0.0))) / 1e6
    scale = F.lit(sentences_per_1000_customers) if isinstance(sentences_per_1000_customers, int) \
        else sentences_per_1000_customers
    return means.join(priced, "run", "left").select(
        F.col("run").alias("classifier"),
        F.bround(F.coalesce("tokens_in", F.lit(0.0)), 0).cast("bigint").alias("input_tokens"),
        F.bround(out, 0).cast("bigint").alias("output_tokens"),
        usd.alias("usd_per_sentence"), F.round(usd * scale, 2).alias("usd_per_1000_customers"))


def prompt_tokens(sentences: DataFrame, texts: DataFrame | None = None, *, chars_per_token: float = 4.0) -> DataFrame:
    """One row: roughly how many tokens the states of the distinct sentences amount to.

    As in `with_state`, `texts` (review_key, review_text) lets the sentences travel without their review.
    The sizes are those of the states' parts: a review is measured once, however many sentences it has.
    """
    sized = with_state(distinct_sentences(sentences), texts, size="size").select("size")
    return sized.agg(F.count(F.lit(1)).alias("sentences"),
                     F.bround(F.sum("size") / F.lit(chars_per_token), 0).cast("bigint").alias("prompt_tokens"))
