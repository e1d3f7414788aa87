"""Scoring sentences as a Spark job: questions, state, what is still to ask, scoring, flattening.

The scorer is the user's code. Everything around it is DataFrame work: equal texts are asked once,
known answers are not asked again, failures are kept apart and retried, and stored answers can be
read under another threshold without asking again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    CHOICES,
    FLAGS,
    FRUSTRATION_LEVELS,
    FRUSTRATION_TOP,
    INSTRUCTIONS,
    LANGUAGE_LABELS,
    PROBLEM_CATEGORIES,
    QUESTION_SET_VERSION,
    RECOMMENDATION_LABELS,
    SENTIMENT_LABELS,
    STATE_NOTE,
    STATE_TASK,
    YES_THRESHOLD,
)
from feedloom.functions.keys import product_slug
from feedloom.schemas import ANSWERS_DDL, KEY, RAW_ANSWERS_DDL, conform

MENTION = "mentions__"
STATE_CHARS = 1 << 24  # of the states that are handed to a scorer at once
ANSWERS_JSON = "map<string,struct<score:double,choice:string,probability:double,confidence:double>>"
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


# --- the question set ------------------------------------------------------------------------

def question_set(catalogue: DataFrame) -> DataFrame:
    """One row per question: name, kind, instructions, labels, version. Products add one question each.

    One question speaks of the whole range: its wording holds `{range}`, which stands for the rows of
    `product_range`, so that a catalogue of any size stays a table.
    """
    spark = catalogue.sparkSession
    labelled = {
        "problem_category": list(PROBLEM_CATEGORIES.items()),
        "language": [(name, None) for name in LANGUAGE_LABELS],
        "sentiment": list(SENTIMENT_LABELS.items()),
        "recommendation": list(RECOMMENDATION_LABELS.items()),
    }
    written = lambda pairs: [name if text is None else f"{name}: {text}" for name, text in pairs]
    rows = [("frustration", "score", INSTRUCTIONS["frustration"], FRUSTRATION_LEVELS)]
    rows += [(c, "choice", INSTRUCTIONS[c], written(labelled[c])) for c in CHOICES]
    rows += [(f, "probability", INSTRUCTIONS[f], []) for f in FLAGS]
    fixed = spark.createDataFrame(rows, "question STRING, kind STRING, instructions STRING, labels ARRAY<STRING>")
    asked = F.replace(F.replace(F.lit(INSTRUCTIONS["mentions"]), F.lit("{product}"), F.col("product_name")),
                      F.lit("{category}"), F.col("product_category"))
    mentions = catalogue.select(
        F.concat(F.lit(MENTION), product_slug(F.col("product_name"))).alias("question"),
        F.lit("probability").alias("kind"), asked.alias("instructions"),
        F.array().cast("array<string>").alias("labels"))
    return fixed.unionByName(mentions).withColumn("version", F.lit(QUESTION_SET_VERSION))


def product_range(catalogue: DataFrame) -> DataFrame:
    """What `{range}` stands for: one row per product (question, product_category, product_name), to be quoted in
    the order of category and name."""
    return catalogue.select(F.lit("competitor_mention").alias("question"), "product_category", "product_name").distinct()


def _state(*more: Column) -> Column:
    position = F.concat((F.col("sentence_index") + 1).cast("string"), F.lit(" of "), F.col("sentence_count").cast("string"))
    return F.to_json(F.struct(
        F.lit(STATE_TASK).alias("task"), F.lit(STATE_NOTE).alias("note"), F.col("sentence"),
        position.alias("sentence_position"),
        F.struct(F.col("product_name").alias("product_reviewed"), "product_category", *more).alias("review")))


def sentence_state(*, text: str = "review_text") -> Column:
    """The JSON a scorer sees for one sentence: the sentence and its whole review, never the rating or the customer."""
    return _state(F.col(text).alias("full_text"))


def with_state(sentences: DataFrame, texts: DataFrame | None = None, *, size: str | None = None) -> DataFrame:
    """Add `state`. With `texts` (review_key, review_text) the text is joined in here, so sentences travel without it, and
    is written as JSON once per review: each state is put together from that and the sentence's own part.

    `size` names a column for the number of characters of the state. It is added up from the same parts, so a text is
    measured once per review, not once per sentence, and who asks for the size alone has no state made."""
    if texts is None:
        stated = sentences.withColumn("state", sentence_state())
        return stated.withColumn(size, F.length("state").cast("bigint")) if size else stated
    parts = _around(sentences).join(_written(texts), "review_key").withColumn("__comma", _comma())
    stated = parts.withColumn("state", F.concat(_opening(), "__comma", "__quoted", F.lit("}}")))
    if size:
        stated = stated.withColumn(size, F.col("__around_size") + F.length("__comma") + F.col("__quoted_size"))
    return stated.drop("__around", "__around_size", "__bare", "__comma", "__quoted", "__quoted_size")


def _written(texts: DataFrame) -> DataFrame:
    """Texts as JSON without the braces: `"full_text":"..."`, or nothing where there is no text."""
    quoted = F.to_json(F.struct(F.col("review_text").alias("full_text")))
    return texts.select("review_key", "review_text", quoted.alias("__json")).select(
        "review_key", "review_text", F.expr("substring(__json, 2, length(__json) - 2)").alias("__quoted"),
        (F.length("__json").cast("bigint") - 2).alias("__quoted_size"))


def _around(sentences: DataFrame) -> DataFrame:
    """Add the part of a state around the text; it ends with the braces of the review and the whole. `__bare`: nothing in the
    review precedes the text."""
    return sentences.withColumn("__around", _state()).withColumns({
        "__around_size": F.length("__around").cast("bigint"),
        "__bare": F.col("product_name").isNull() & F.col("product_category").isNull()})


def _comma() -> Column:
    return F.when(F.col("__bare") | (F.col("__quoted_size") == 0), "").otherwise(",")


def _opening() -> Column:
    return F.substr("__around", F.lit(1), (F.col("__around_size") - 2).cast("int"))


# --- what is still to ask --------------------------------------------------------------------

def distinct_sentences(sentences: DataFrame) -> DataFrame:
    """One row per sentence key: that of the smallest review_id. Equal keys meet once, combined before the shuffle.

    Every column travels with every sentence: select those wanted first, and join the review text later."""
    others = [c for c in sentences.columns if c not in KEY]
    first = F.min_by(F.struct(*others), "review_id").alias("first")
    return sentences.groupBy(*KEY).agg(first).select(*[c if c in KEY else f"first.{c}" for c in sentences.columns])


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """One row per content key, before splitting: its sentences are exactly the distinct sentences."""
    first = reviews.groupBy("review_key").agg(F.min("review_id").alias("review_id"))
    return reviews.join(first, ["review_key", "review_id"], "left_semi")


def cache_misses(sentences: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct sentences without a valid stored answer."""
    return distinct_sentences(sentences).join(answers.select(*KEY), KEY, "left_anti")


def valid_answers(answers: DataFrame, version: str = QUESTION_SET_VERSION, model: str | None = None) -> DataFrame:
    """Stored answers that may be reused: same question set, no error, and the same model if one is named."""
    ok = (F.col("question_set_version") == version) & F.col("error").isNull()
    return answers.where(ok if model is None else ok & (F.col("model") == model))


# --- scoring ---------------------------------------------------------------------------------

def per_sentence(ask: Callable[[dict], dict], *, model: str, concurrency: int = 8) -> Scorer:
    """Turn `ask(row) -> {"answers": {...}, "input_tokens": n, "output_tokens": n}` into a scorer.

    Calls run on a small pool inside the task, whose threads take the next sentence themselves: handing each to the pool took
    longer than a quick call. A call that raises gives a row with the error and no answers; it never fails the task.
    """
    def one(row: dict) -> tuple:
        said, error, started = (None, None, None, None), None, time.perf_counter()
        try:
            reply = ask(row)
            said = (json.dumps(reply["answers"]), reply.get("model", model), reply.get("input_tokens"),
                    reply.get("output_tokens"))
        except Exception as exc:  # noqa: BLE001 - reported in the row, retried by the next run
            error = f"{type(exc).__name__}: {exc}"
        return *(row[k] for k in KEY), *said, round((time.perf_counter() - started) * 1000), error  # as RAW_ANSWERS_DDL

    def scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RAW_ANSWERS_DDL.split(", ")]
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                given = batch.to_dict("records")
                rows = [None] * len(given)
                places = iter(range(len(given)))  # each is taken once, by whichever thread is free

                def work(_: int) -> None:
                    for k in places:
                        rows[k] = one(given[k])

                list(pool.map(work, range(concurrency)))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int64" for c in ("input_tokens", "output_tokens", "latency_ms")})

    return scorer


def with_failed(scorer: Scorer, columns: list[str], kept: list[str]) -> Scorer:
    """`scorer`, given only `columns`, with the columns `kept` of what it was given beside each error."""
    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = {}  # what was given and is not answered yet

        def given() -> Iterator[pd.DataFrame]:
            for batch in batches:
                waiting.update(zip(zip(*(batch[c] for c in KEY)), zip(*(batch[c] for c in kept))))
                yield batch[columns]

        for answered in scorer(given()):
            found = [waiting.pop(key, None) for key in zip(*(answered[c] for c in KEY))]
            rows = [None if row is None or pd.isna(error) else row for row, error in zip(found, answered["error"])]
            yield answered.assign(**{c: pd.Series([None if row is None else row[k] for row in rows], answered.index, object)
                                     for k, c in enumerate(kept)})

    return beside


def with_states(scorer: Scorer, columns: list[str]) -> Scorer:
    """`scorer`, given `columns` with states put together here from `__state_opening` and the `__state_rest` of the review,
    which only the first row of a review has; at most STATE_CHARS and a state at a time."""
    parts = ["review_key", "__state_opening", "__state_rest"]

    def stated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        review, rest = None, None
        for batch in batches:
            states, size, first = [], 0, 0
            for last, (key, opening, mine) in enumerate(zip(*(batch[c] for c in parts)), 1):
                if mine is not None:
                    review, rest = key, mine
                elif key != review:
                    raise RuntimeError(f"a sentence of review {key} came without its text")
                states.append(opening + rest)
                size += len(states[-1])
                if size >= STATE_CHARS or last == len(batch):
                    yield batch.iloc[first:last].assign(state=states)[columns].reset_index(drop=True)
                    states, size, first = [], 0, last

    return lambda batches: scorer(stated(batches))


def score_sentences(misses: DataFrame, scorer: Scorer, *, columns: list[str], partitions: int | None = None,
                    texts: DataFrame | None = None, beside_errors: list[str] | None = None) -> DataFrame:
    """Run the scorer over `misses[columns]` on the executors; calls in flight = partitions x the scorer's own.

    `columns` names what the scorer reads, so the review text is only sent when it asks for the state. With `texts`
    (review_key, review_text) the states are made where they are scored: sentences are spread by their review, meet its
    text there, and no state is ever shuffled or handed from process to process. `beside_errors` names columns to give
    back with each error, null beside answers; not with `texts`.
    Write the result before using it twice: a lost executor would ask again for what it had.
    """
    if texts is not None:
        spread = [partitions] if partitions else []
        asked = misses.repartition(*spread, "review_key")
        written = texts.select("review_key", "review_text").repartition(*spread, "review_key")
        if "state" not in columns:
            return asked.join(written, "review_key").select(*columns).mapInPandas(scorer, RAW_ANSWERS_DDL)
        # the text goes to the scorer's process once per review, beside its first sentence
        first = F.row_number().over(Window.partitionBy("review_key").orderBy("sentence_index")) == 1
        met = _around(asked).withColumn("__first", first).join(_written(written), "review_key").select(
            *[c for c in dict.fromkeys(["review_key", *columns]) if c != "state"],
            F.concat(_opening(), _comma()).alias("__state_opening"),
            F.when(F.col("__first"), F.concat("__quoted", F.lit("}}"))).alias("__state_rest"), "__first")
        return met.sortWithinPartitions("review_key", F.desc("__first")).drop("__first").mapInPandas(
            with_states(scorer, columns), RAW_ANSWERS_DDL)
    kept = beside_errors or []
    narrow = misses.select(*dict.fromkeys([*columns, *(KEY if kept else []), *kept]))
    spread = narrow.repartition(partitions, *KEY) if partitions else narrow
    if not kept:
        return spread.mapInPandas(scorer, RAW_ANSWERS_DDL)
    more = [f"{c} {misses.schema[c].dataType.simpleString()}" for c in kept]
    return spread.mapInPandas(with_failed(scorer, columns, kept), ", ".join([RAW_ANSWERS_DDL, *more]))


# --- reading answers -------------------------------------------------------------------------

def _between(c: str | Column, top: float) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), value)))


def unit(c: str | Column) -> Column:
    """Clip a probability or confidence into 0..1; null stays null."""
    return _between(c, 1.0)


def clip(c: str | Column) -> Column:
    """Clip a frustration score into 0..4; null stays null."""
    return _between(c, FRUSTRATION_TOP)


def mentioned_products(parsed: DataFrame, catalogue: DataFrame, threshold: float = YES_THRESHOLD) -> DataFrame:
    """(key, products_mentioned): product names whose mention probability clears the threshold, sorted.

    Names come through a join on the slug, so the catalogue may be of any size. The set gathered per
    sentence holds only products named in that sentence.
    """
    slugs = catalogue.select(product_slug(F.col("product_name")).alias("slug"), "product_name").distinct()
    # explode the mentions only, and in the outer form: see split_sentences
    named = F.filter(F.map_entries("answers"), lambda e: e["key"].startswith(MENTION))
    entries = parsed.select(*KEY, F.explode_outer(named).alias("e")).where(F.col("e").isNotNull()) \
        .where(unit(F.col("e.value.probability")) >= threshold) \
        .select(*KEY, F.expr(f"substring(e.key, {len(MENTION) + 1})").alias("slug"))
    return entries.join(slugs, "slug").groupBy(*KEY).agg(
        F.array_sort(F.collect_set("product_name")).alias("products_mentioned"))


def parse_answers(raw: DataFrame) -> DataFrame:
    """Add `answers`, the JSON object as a map of question -> typed answer."""
    return raw.withColumn("answers", F.from_json("answers_json", ANSWERS_JSON))


def flatten_answers(raw: DataFrame, catalogue: DataFrame, threshold: float = YES_THRESHOLD,
                    version: str = QUESTION_SET_VERSION, *, stored: bool = False) -> DataFrame:
    """Scorer output as one flat row per key in the answer schema, clipped; failures keep their error and nulls.

    With `stored`, `raw` is a stored table that may be read twice: answers that speak of no product then stay where they
    are, and only the others meet the names of products by their keys."""
    if stored:
        # a JSON key may also be written with escapes
        named = F.coalesce(F.col("answers_json").contains(MENTION) | F.col("answers_json").contains("\\u"), F.lit(False))
        nothing = F.when(F.col("error").isNull(), F.array().cast("array<string>"))
        return flatten_answers(raw.where(named), catalogue, threshold, version).unionByName(
            conform(_flat(parse_answers(raw.where(~named)), version).withColumn("products_mentioned", nothing), ANSWERS_DDL))
    parsed = parse_answers(raw)
    named = _flat(parsed, version).join(mentioned_products(parsed, catalogue, threshold), KEY, "left").withColumn(
        "products_mentioned",
        F.when(F.col("error").isNull(), F.coalesce("products_mentioned", F.array().cast("array<string>"))))
    return conform(named, ANSWERS_DDL)


def _flat(parsed: DataFrame, version: str) -> DataFrame:
    """Parsed answers as flat columns, without the products."""
    a = lambda q, part: F.col("answers")[q][part]
    return parsed.select(
        *KEY,
        clip(a("frustration", "score")).alias("frustration"),
        unit(a("frustration", "confidence")).alias("frustration_confidence"),
        *[a(c, "choice").alias(c) for c in CHOICES],
        *[unit(a(c, "confidence")).alias(f"{c}_confidence") for c in CHOICES],
        *[unit(a(f, "probability")).alias(f) for f in FLAGS],
        "answers_json", "model", F.lit(version).alias("question_set_version"), "input_tokens", "output_tokens",
        "latency_ms", "error")


def rethreshold(answers: DataFrame, catalogue: DataFrame, threshold: float) -> DataFrame:
    """Stored answers with `products_mentioned` decided again under another threshold."""
    again = mentioned_products(parse_answers(answers), catalogue, threshold)
    return conform(
        answers.drop("products_mentioned").join(again, KEY, "left").withColumn(
            "products_mentioned",
            F.when(F.col("error").isNull(), F.coalesce("products_mentioned", F.array().cast("array<string>")))),
        ANSWERS_DDL)


def explode_answers(answers: DataFrame) -> DataFrame:
    """One row per key and question, decoded from the stored JSON."""
    return parse_answers(answers).select(*KEY, F.explode_outer("answers").alias("question", "answer")) \
        .where(F.col("question").isNotNull()).select(*KEY, "question", "answer.*")


def attach_answers(sentences: DataFrame, answers: DataFrame) -> DataFrame:
    """Every sentence with its answers; repeated texts share them, unanswered sentences keep nulls."""
    return sentences.join(answers, KEY, "left")


def usage_summary(answers: DataFrame) -> DataFrame:
    """One row: models, mean latency, tokens, failed calls."""
    return answers.agg(
        F.array_join(F.array_sort(F.collect_set("model")), ";").alias("models"),
        F.count(F.lit(1)).alias("answers"), F.bround(F.avg("latency_ms"), 0).alias("mean_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))


def failed_sentences(answers: DataFrame) -> DataFrame:
    """Errors with how often each occurred."""
    return answers.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("sentences"))

