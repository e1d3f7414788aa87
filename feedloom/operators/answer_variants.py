"""Scorer answers as a VARIANT column: the JSON text is parsed once, when it is written, and read by path afterwards.

`with_variant` is the only place that parses. What reads the stored column takes single fields out of its binary form, so
a query for one question never decodes the others. Rows are those of the functions of `classify` over JSON text, with two
differences in what a scorer may get wrong: a number given as text (`"0.7"`) counts as that number, and an object that
names a question twice is no answer at all. Text that is no JSON object gives nulls, as there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import CHOICES, FLAGS, QUESTION_SET_VERSION, YES_THRESHOLD
from feedloom.functions.keys import product_slug
from feedloom.operators.classify import ANSWERS_JSON, MENTION, clip, unit
from feedloom.schemas import KEY

PARTS = {"score": "double", "choice": "string", "probability": "double", "confidence": "double"}


def with_variant(raw: DataFrame) -> DataFrame:
    """`raw` with `answers` (VARIANT) in place of `answers_json`. Store the result: this parses."""
    return raw.withColumn("answers", F.try_parse_json("answers_json")).drop("answers_json")


def answer(question: str, part: str) -> Column:
    """One part of one answer; null where the question or the part is missing or of another type."""
    return F.try_variant_get("answers", f"$.{question}.{part}", PARTS[part])


def entries(stored: DataFrame) -> DataFrame:
    """(KEY, question, answer VARIANT), one row per question answered."""
    listed = F.try_variant_get("answers", "$", "map<string,variant>")
    # exploded in the outer form, as everywhere: the inner one would have the map computed twice
    return stored.select(*KEY, F.explode_outer(listed).alias("question", "answer")).where(F.col("question").isNotNull())


def explode_answers(stored: DataFrame) -> DataFrame:
    """One row per key and question with its score, choice, probability and confidence."""
    # all parts of all answers are taken in one walk over a row, not by a path each
    listed = F.try_variant_get("answers", "$", ANSWERS_JSON)
    return stored.select(*KEY, F.explode_outer(listed).alias("question", "answer")) \
        .where(F.col("question").isNotNull()).select(*KEY, "question", *[f"answer.{part}" for part in PARTS])


def mentioned_products(stored: DataFrame, catalogue: DataFrame, threshold: float = YES_THRESHOLD) -> DataFrame:
    """(KEY, products_mentioned): names whose mention probability reaches the threshold, sorted; keys without any are
    absent. Names are met by a join on the slug, so the catalogue may be of any size."""
    slugs = catalogue.select(product_slug(F.col("product_name")).alias("slug"), "product_name").distinct()
    # mentions alone are exploded, not every question; entries of a map are taken in the outer form, as above
    listed = F.map_entries(F.try_variant_get("answers", "$", "map<string,variant>"))
    mentions = stored.select(*KEY, F.explode_outer(F.filter(listed, lambda e: e["key"].startswith(MENTION))).alias("e"))
    likely = mentions.where(F.col("e").isNotNull()).select(*KEY, F.col("e.key").alias("question"), F.col("e.value").alias("answer")) \
        .where(unit(F.try_variant_get("answer", "$.probability", "double")) >= threshold) \
        .select(*KEY, F.substr("question", F.lit(len(MENTION) + 1)).alias("slug"))
    return likely.join(slugs, "slug").groupBy(*KEY).agg(
        F.array_sort(F.collect_set("product_name")).alias("products_mentioned"))


def rethreshold(stored: DataFrame, catalogue: DataFrame, threshold: float) -> DataFrame:
    """`stored` with `products_mentioned` under a threshold: empty where nothing is mentioned, null for failures."""
    named = mentioned_products(stored, catalogue, threshold)
    none = F.array().cast("array<string>")
    return stored.drop("products_mentioned").join(named, KEY, "left").withColumn(
        "products_mentioned", F.when(F.col("error").isNull(), F.coalesce("products_mentioned", none)))


def flatten_answers(stored: DataFrame, catalogue: DataFrame, threshold: float = YES_THRESHOLD,
                    version: str = QUESTION_SET_VERSION) -> DataFrame:
    """One flat, clipped row per key; the variant stays beside, so another threshold or question needs no new run."""
    sure = {q: unit(answer(q, "confidence")).alias(f"{q}_confidence") for q in ("frustration", *CHOICES)}
    flat = stored.select(
        *KEY, clip(answer("frustration", "score")).alias("frustration"), sure["frustration"],
        *[answer(c, "choice").alias(c) for c in CHOICES], *[sure[c] for c in CHOICES],
        *[unit(answer(f, "probability")).alias(f) for f in FLAGS], "answers", "model",
        F.lit(version).alias("question_set_version"), "input_tokens", "output_tokens", "latency_ms", "error")
    return rethreshold(flat, catalogue, threshold)
