"""From classified sentences to review and product insight. Thresholds are always arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import CARRIED, FLAGS, NO_ISSUE, YES_THRESHOLD


def cents(value: str | Column) -> Column:
    """Two digits, rounded half up from six decimal digits: so it does not hang on how a binary fraction is stored."""
    number = F.col(value) if isinstance(value, str) else value
    return F.round(number.cast("decimal(18,6)"), 2).cast("double")


def _measures(sentences: DataFrame, threshold: float, key: str, carried: list[str]) -> DataFrame:
    """Everything a review needs from its sentences, in one aggregate.

    Mentions are exploded first and the other measures look at each sentence's first row only, so the
    sets gathered per review hold distinct values, never one entry per sentence.
    """
    rows = sentences.select(
        key, *carried, "sentence_index", "frustration", "problem_category", "sentiment", *FLAGS,
        F.posexplode_outer("products_mentioned").alias("__mention", "__product"))
    once = F.coalesce(F.col("__mention"), F.lit(0)) == 0
    problem = F.when(F.col("problem_category") != "none", F.col("problem_category"))
    rank = F.when(problem.isNotNull(), F.struct("frustration", -F.col("sentence_index")))
    return rows.groupBy(key).agg(
        *[F.any_value(c, True).alias(c) for c in carried],
        F.count_if(once).alias("sentences"),
        F.max("frustration").alias("peak_frustration"),
        F.avg(F.when(once, F.col("frustration"))).alias("mean_frustration"),
        F.array_sort(F.collect_set(problem)).alias("problems"),
        F.array_sort(F.collect_set("__product")).alias("products_mentioned"),
        *[F.coalesce(F.bool_or(F.col(f) >= threshold), F.lit(False)).alias(f) for f in FLAGS],
        F.count_if(once & (F.col("sentiment") == "positive")).alias("positive_sentences"),
        F.count_if(once & (F.col("sentiment") == "negative")).alias("negative_sentences"),
        F.max_by(problem, rank).alias("primary_issue"),
    )


EXTRA = ["positive_sentences", "negative_sentences", "primary_issue"]


def _rolled(sentences: DataFrame, threshold: float, facts: DataFrame | None, key: str) -> DataFrame:
    if facts is None:
        return _measures(sentences, threshold, key, [c for c in CARRIED if c in sentences.columns])
    return facts.join(_measures(sentences, threshold, key, []), key)


def review_rollup(sentences: DataFrame, threshold: float = YES_THRESHOLD, *, facts: DataFrame | None = None,
                  key: str = "review_id") -> DataFrame:
    """One row per review: its facts, peak and mean frustration, problems, products and flags.

    Without `facts` the review's columns are taken from its sentences. Passing `facts` (one row per
    review) keeps them out of the aggregate; with `key="review_key"` each distinct text is rolled up
    once and shared by all reviews that have it.
    """
    return _rolled(sentences, threshold, facts, key).drop(*EXTRA)


def reviews_view(sentences: DataFrame, threshold: float = YES_THRESHOLD, *, facts: DataFrame | None = None,
                 key: str = "review_id") -> DataFrame:
    """The roll-up with sentence counts by sentiment, both review sentiments and the primary issue."""
    positive, negative = F.col("positive_sentences"), F.col("negative_sentences")
    return _rolled(sentences, threshold, facts, key).withColumns({
        "text_sentiment": text_sentiment(positive, negative),
        "star_sentiment": star_sentiment(F.col("rating")),
        "primary_issue": F.coalesce("primary_issue", F.lit(NO_ISSUE)),
    })


def text_sentiment(positive: Column, negative: Column) -> Column:
    """Whichever kind of sentence is in the majority; mixed when they tie."""
    return F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("mixed")


def star_sentiment(rating: Column) -> Column:
    return F.when(rating <= 2, "negative").when(rating == 3, "mixed").otherwise("positive")


def frustration_by_rating(reviews: DataFrame) -> DataFrame:
    """Frustration should fall as stars rise, although the scorer never saw the stars."""
    return reviews.groupBy("rating").agg(
        F.count(F.lit(1)).alias("reviews"),
        cents(F.avg("peak_frustration")).alias("peak_frustration"),
        cents(F.avg("mean_frustration")).alias("mean_frustration"))


def problems_by_product(sentences: DataFrame) -> DataFrame:
    """Per product and kind of problem: sentences, reviews and mean frustration."""
    return sentences.where(F.col("problem_category") != "none").groupBy("product_name", "problem_category").agg(
        F.count(F.lit(1)).alias("sentences"), F.countDistinct("review_id").alias("reviews"),
        cents(F.avg("frustration")).alias("mean_frustration"))


def problem_pivot(problems: DataFrame, categories: list[str]) -> DataFrame:
    """Product by problem, counting sentences; combinations that never occur are 0."""
    return problems.groupBy("product_name").pivot("problem_category", categories).agg(F.sum("sentences")) \
        .na.fill(0, categories)


def top_problem_areas(problems: DataFrame, *, min_reviews: int = 3, n: int = 10) -> DataFrame:
    """The most frustrating product problems that enough reviews raise."""
    return problems.where(F.col("reviews") >= min_reviews) \
        .orderBy(F.desc("mean_frustration"), "product_name", "problem_category").limit(n)


def cross_mentions(sentences: DataFrame) -> DataFrame:
    """Distinct sentences that name another product than the one reviewed."""
    return sentences.select("product_name", "sentence", F.explode("products_mentioned").alias("also_mentions")) \
        .where(F.col("also_mentions") != F.col("product_name")) \
        .select("product_name", "also_mentions", "sentence").distinct()


def flagged(sentences: DataFrame, flag: str, threshold: float = YES_THRESHOLD) -> DataFrame:
    """Distinct sentences whose flag clears the threshold, with how often each occurs: the most certain first."""
    first = F.struct("review_id", "sentence_index")
    return sentences.where(F.col(flag) >= threshold).groupBy("product_name", "sentence").agg(
        cents(F.min_by(flag, first)).alias(flag), F.count(F.lit(1)).alias("occurrences"),
        cents(F.min_by("frustration", first)).alias("frustration")).orderBy(F.desc(flag), "product_name", "sentence")


def needs_review(sentences: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Distinct sentences whose problem category is too uncertain to trust: the least certain first."""
    return sentences.where(F.col("problem_category_confidence") < min_confidence).select(
        "product_name", "sentence", "problem_category",
        cents("problem_category_confidence").alias("problem_category_confidence")).distinct() \
        .orderBy("problem_category_confidence", "product_name", "sentence")


def language_confusion(sentences: DataFrame) -> DataFrame:
    """Language written by language heard, with the lowest confidence."""
    return sentences.groupBy("text_language", "language").agg(
        F.count(F.lit(1)).alias("sentences"), F.min("language_confidence").alias("min_confidence"))


def most_frustrated(reviews: DataFrame, *, n: int = 10, text: str = "review_text") -> DataFrame:
    """The n most frustrated reviews, one per text. `text` may name a hash of it, so long texts need not come along."""
    scored = reviews.where(F.col("peak_frustration").isNotNull())
    per_text = scored.groupBy(F.sha1(text)).agg(F.min(F.struct(-F.col("peak_frustration"), "review_id")).alias("top"))
    ids = per_text.select("top.*").toDF("worst_first", "review_id").orderBy("worst_first", "review_id").limit(n)
    return reviews.join(ids.select("review_id"), "review_id", "left_semi")


def rating_share(reviews: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Stars with their share of reviews, and the share of purchases that are reviewed at all."""
    purchases = order_lines.agg(F.count(F.lit(1))).scalar()
    counted = reviews.groupBy("rating").agg(F.count(F.lit(1)).alias("reviews"))
    total = F.sum("reviews").over(Window.partitionBy())  # five rows
    return counted.select("rating", "reviews", F.round(F.col("reviews") / total, 3).alias("share"),
                          F.round(F.try_divide(total, purchases), 4).alias("reviewed_share"))


def result_meta(sentences: DataFrame) -> DataFrame:
    """One row: which model and question set answered, and who wrote the texts."""
    return sentences.agg(
        F.min("model").alias("model"), F.min("question_set_version").alias("question_set_version"),
        F.array_join(F.array_sort(F.collect_set("text_model")), ", ").alias("text_models"))

