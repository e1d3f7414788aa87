"""Bookkeeping around written review texts: briefs, prompts, cache, backlog and estimates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    CLASSIFIER_CONCURRENCY,
    CLASSIFIER_SECONDS_PER_SENTENCE,
    CLASSIFIER_TOKENS_PER_SENTENCE,
    CLASSIFIER_USD_PER_MILLION_INPUT,
    FEELINGS,
    WRITER_CONCURRENCY,
    WRITER_LANGUAGE_NAMES,
    WRITER_PROMPT,
    WRITER_PROMPT_TOKENS,
    WRITER_SECONDS_PER_REVIEW,
    WRITER_SYSTEM,
    WRITER_TOKENS_PER_SENTENCE,
)
from feedloom.functions.keys import SEPARATOR, stable_int
from feedloom.schemas import TEXT_DDL

BRIEF = ["review_id", "product_name", "product_category", "product_description", "rating", "satisfaction", "aspect",
         "language"]


def review_briefs(reviews: DataFrame, truth: DataFrame, products: DataFrame) -> DataFrame:
    """What each review's text is to be about."""
    named = products.select("product_id", "product_name", F.col("category").alias("product_category"),
                            F.col("description").alias("product_description"))
    meant = truth.select("review_id", "satisfaction", "aspect", "language")
    return reviews.select("review_id", "product_id", "rating").join(meant, "review_id").join(named, "product_id") \
        .select(BRIEF)


def brief_length(review_id: Column) -> Column:
    """Sentences asked for: 2 to 7, fixed by the id."""
    return (stable_int(review_id.cast("string")) % 6 + 2).cast("int")


def feeling(satisfaction: Column) -> Column:
    """Satisfaction in words."""
    words = F.when(F.lit(False), "")
    for bound, wording in FEELINGS:
        words = words.otherwise(wording) if bound is None else words.when(satisfaction < bound, wording)
    return words


def language_name(language: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WRITER_LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(names[language], language)


def with_prompt(briefs: DataFrame, model: str) -> DataFrame:
    """Add `sentences`, `prompt` and `prompt_hash`; the hash covers the writer, its instructions and the prompt."""
    values = {"feeling": feeling(F.col("satisfaction")), "aspect": F.replace(F.col("aspect"), F.lit("_"), F.lit(" ")),
              "language": language_name(F.col("language"))}
    lines = F.concat(*[values.get(part, F.col(part)).cast("string") if k % 2 else F.lit(part)
                       for k, part in enumerate(re.split(r"\{(\w+)\}", WRITER_PROMPT))])
    hashed = F.substring(F.sha2(F.concat_ws(SEPARATOR, F.lit(model), F.lit(WRITER_SYSTEM), "prompt"), 256), 1, 16)
    return briefs.withColumn("sentences", brief_length(F.col("review_id"))).withColumn("prompt", lines) \
        .withColumn("prompt_hash", hashed)


PROMPTED = ["review_id", "prompt_hash"]


def cached_texts(prompted: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored texts for exactly these prompts, one per review."""
    found = cache.join(prompted.select(*PROMPTED), PROMPTED, "left_semi")
    others = [c for c in found.columns if c not in PROMPTED]
    return found.groupBy(*PROMPTED).agg(F.min(F.struct(*others)).alias("first")).select(
        *[c if c in PROMPTED else f"first.{c}" for c in found.columns])  # of several always the same


def texts_to_write(prompted: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts no stored text answers."""
    return prompted.join(cache.select(*PROMPTED), PROMPTED, "left_anti")


def text_backlog(reviews: DataFrame, texts: DataFrame, truth: DataFrame, products: DataFrame) -> DataFrame:
    """Briefs of reviews that still have no text, so every batch tries them again."""
    waiting = reviews.join(texts.select("review_id"), "review_id", "left_anti")
    return review_briefs(waiting, truth, products)


def write_texts(todo: DataFrame, write: Callable[[dict], str], *, model: str, concurrency: int = 8,
                partitions: int | None = None) -> DataFrame:
    """Run a writer over prompts on the executors: text rows plus `error` for calls that raised.

    Store the rows whose error is null with `append_texts`; the others are tried again by the next run.
    """
    def one(row: dict) -> dict:
        out = {"review_id": row["review_id"], "prompt_hash": row["prompt_hash"], "language": row["language"],
               "model": model, "generated_at": datetime.now(UTC).replace(tzinfo=None), "review_text": None, "error": None}
        try:
            out["review_text"] = write(row)
        except Exception as exc:  # noqa: BLE001 - reported in the row, retried by the next run
            out["error"] = f"{type(exc).__name__}: {exc}"
        return out

    ddl = TEXT_DDL + ", error STRING"
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.to_dict("records"))), columns=names)

    spread = todo.repartition(partitions, "review_id") if partitions else todo
    kind = todo.schema["review_id"].dataType.simpleString()
    return spread.mapInPandas(run, ddl.replace("review_id STRING", f"review_id {kind}"))


def batch_estimate(briefs: DataFrame, *, usd_per_million_input: float | None = None,
                   usd_per_million_output: float | None = None) -> DataFrame:
    """One row: what writing and classifying these briefs will take. Writing is costed only when priced."""
    priced = usd_per_million_input is not None and usd_per_million_output is not None
    counted = briefs.agg(F.count(F.lit(1)).alias("reviews"),
                         F.coalesce(F.sum(brief_length(F.col("review_id"))), F.lit(0)).alias("sentences"))
    sized = counted.select(
        "*", (F.col("sentences") * CLASSIFIER_TOKENS_PER_SENTENCE).alias("classifier_tokens"),
        (F.col("reviews") * WRITER_PROMPT_TOKENS).alias("writer_input_tokens"),
        (F.col("sentences") * WRITER_TOKENS_PER_SENTENCE).alias("writer_output_tokens"))
    usd = F.col("writer_input_tokens") / 1e6 * F.lit(usd_per_million_input) \
        + F.col("writer_output_tokens") / 1e6 * F.lit(usd_per_million_output) if priced else F.lit(None).cast("double")
    return sized.select(
        "*", (F.col("classifier_tokens") / 1e6 * CLASSIFIER_USD_PER_MILLION_INPUT).alias("classifier_usd"),
        (F.col("sentences") * CLASSIFIER_SECONDS_PER_SENTENCE / CLASSIFIER_CONCURRENCY / 60).alias("classifier_minutes"),
        usd.alias("writer_usd"),
        (F.col("reviews") * WRITER_SECONDS_PER_REVIEW / WRITER_CONCURRENCY / 60).alias("writer_minutes"))
