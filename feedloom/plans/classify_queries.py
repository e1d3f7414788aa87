"""Question set, state, cache, scoring and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import CHOICES, FLAGS, INSTRUCTIONS, QUESTION_SET_VERSION, STATE_NOTE, STATE_TASK
from feedloom.operators import answer_variants, classify
from feedloom.operators.load import product_catalogue
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import VIEWS, answers_sql, check_sql, text
from feedloom.plans.feature_queries import longs
from feedloom.plans.lexical import ask
from feedloom.plans.registry import query
from feedloom.schemas import KEY
from feedloom.session import materialise


def joined(column: str):
    return F.array_join(column, ";").alias(column)


def rounded(columns: list[str], digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


SCORES = ["frustration", "frustration_confidence", *[f"{c}_confidence" for c in CHOICES], *FLAGS]
SQL_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)
SQL_FLAT = (f"review_key, sentence_index, {SQL_SCORES}, {', '.join(CHOICES)}, "
            "array_to_string(products_mentioned, ';') AS products_mentioned, model, question_set_version, "
            "input_tokens, output_tokens, latency_ms, error")


def flat_columns():
    return ["review_key", *longs("sentence_index"), *rounded(SCORES), *CHOICES, joined("products_mentioned"), "model",
            "question_set_version", "input_tokens", "output_tokens", "latency_ms", "error"]


KINDS = {"frustration": "score", **dict.fromkeys(CHOICES, "choice"), **dict.fromkeys(FLAGS, "probability")}
FIXED_QUESTIONS = ", ".join(f"({text(q)}, {text(kind)}, {text(INSTRUCTIONS[q])})" for q, kind in KINDS.items())


@query("question_set", check_sql(f"""
    SELECT question, kind, sha1(instructions) AS instructions_sha1, '{QUESTION_SET_VERSION}' AS version FROM (
      SELECT question, kind, instructions FROM (VALUES {FIXED_QUESTIONS}) q(question, kind, instructions)
      UNION ALL
      SELECT 'mentions__' || trim(regexp_replace(lower(product_name), '[^a-z0-9]+', '_', 'g'), '_'), 'probability',
        replace(replace({text(INSTRUCTIONS["mentions"])}, '{{product}}', product_name), '{{category}}', category)
      FROM products)""", "products"))
def question_set(d: Domain):
    return classify.question_set(product_catalogue(d.products)).select("question", "kind", F.sha1("instructions").alias("instructions_sha1"),
                                                   "version")


@query("product_range", check_sql("""
    SELECT DISTINCT 'competitor_mention' AS question, category AS product_category, product_name FROM products""",
    "products"))
def product_range(d: Domain):
    return classify.product_range(product_catalogue(d.products))


VIEWS["states"] = (["sentences", "texts"], f"""
    SELECT DISTINCT s.review_key, s.sentence_index, json_object('task', {text(STATE_TASK)}, 'note', {text(STATE_NOTE)},
      'sentence', s.sentence, 'sentence_position', (s.sentence_index + 1) || ' of ' || s.sentence_count,
      'review', json_object('product_reviewed', t.product_name, 'product_category', t.product_category,
                            'full_text', t.review_text))::VARCHAR AS state
    FROM sentences s JOIN texts t USING (review_id)""")


def stated(d: Domain) -> DataFrame:
    """Sentences with what their states are made of, but the text."""
    return d.sentences.select("review_id", *KEY, "sentence_count", "sentence", "product_name", "product_category")


@query("sentence_state", check_sql("""
    SELECT review_key, sentence_index, sha1(state) AS state_sha1, length(state) AS state_length FROM states""", "states"))
def sentence_state(d: Domain):
    asked = classify.distinct_sentences(stated(d))
    texts = classify.distinct_reviews(d.texts)
    return classify.with_state(asked, texts, size="state_length").select(
        "review_key", *longs("sentence_index"), F.sha1("state").alias("state_sha1"), "state_length")


@query("distinct_sentences", check_sql("""
    SELECT review_key, sentence_index, min(review_id) AS review_id, arg_min(sentence, review_id) AS sentence
    FROM sentences GROUP BY 1, 2""", "sentences"))
def distinct_sentences(d: Domain):
    return classify.distinct_sentences(d.sentences.select("review_id", *KEY, "sentence")).select(
        "review_key", *longs("sentence_index"), "review_id", "sentence")


@query("cache_valid_answers", check_sql("""
    SELECT model, count(*) AS answers, min(latency_ms) AS fastest_ms FROM (
      SELECT * FROM answers_a UNION ALL SELECT * FROM answers_b) WHERE error IS NULL GROUP BY 1""",
    "answers_a", "answers_b"))
def cache_valid_answers(d: Domain):
    a, b = d.both_answers("model", "question_set_version", "latency_ms", "error")
    both = a.unionByName(b)
    return classify.valid_answers(both).groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"), F.min("latency_ms").alias("fastest_ms"))


@query("cache_misses", check_sql("""
    SELECT review_key, sentence_index, min(review_id) AS review_id FROM sentences s
    WHERE NOT EXISTS (SELECT 1 FROM answers_a a WHERE a.review_key = s.review_key
                      AND a.sentence_index = s.sentence_index AND a.error IS NULL) GROUP BY 1, 2""",
    "sentences", "answers_a"))
def cache_misses(d: Domain):
    known = classify.valid_answers(d.answers("a"), model="scorer-a")
    return classify.cache_misses(d.sentences.drop("review_text"), known).select(
        "review_key", *longs("sentence_index"), "review_id")


@query("score_sentences", check_sql("""
    SELECT review_key, sentence_index, round(frustration, 6) AS frustration,
      round(frustration_confidence, 6) AS frustration_confidence, model, input_tokens, output_tokens, error
    FROM answers_a""", "answers_a"))
def score_sentences(d: Domain):
    # the scorer is handed the state: the sentence, where it stands, and the whole review
    asked = classify.distinct_sentences(stated(d))
    raw = materialise(classify.score_sentences(asked, classify.per_sentence(ask, model="scorer-a"),
                                               columns=[*KEY, "state"], texts=classify.distinct_reviews(d.texts),
                                               partitions=d.spark.sparkContext.defaultParallelism), "raw_answers")
    catalogue = d.products.select("product_name")
    return classify.flatten_answers(raw, catalogue).select(
        "review_key", *longs("sentence_index"), *rounded(["frustration", "frustration_confidence"]), "model",
        "input_tokens", "output_tokens", "error")


@query("failed_sentences", check_sql("""
    SELECT error, count(*) AS sentences FROM answers_a WHERE error IS NOT NULL GROUP BY 1""", "answers_a"))
def failed_sentences(d: Domain):
    return classify.failed_sentences(d.answers("a"))


@query("flatten_answers", check_sql(f"SELECT {SQL_FLAT} FROM answers_a", "answers_a"))
def flatten_answers(d: Domain):
    return classify.flatten_answers(d.stored("json", "a"), d.products.select("product_name")).select(flat_columns())


@query("clip_answers", check_sql(f"""
    SELECT count(*) AS answers, {', '.join(
        f"count(*) FILTER ({c} < 0 OR {c} > {4 if c == 'frustration' else 1}) AS {c}_clipped" for c in SCORES)}
    FROM raw_a""", "raw_a"))
def clip_answers(d: Domain):
    limit = {"frustration": classify.clip}
    return d.stored("raw", "a").agg(
        F.count(F.lit(1)).alias("answers"),
        *[F.count_if(limit.get(c, classify.unit)(c) != F.col(c)).alias(f"{c}_clipped") for c in SCORES])


def _threshold_sql(threshold: float) -> str:
    return answers_sql("a").replace("_mention >= 0.5", f"_mention >= {threshold}")


@query("products_mentioned", check_sql("""
    SELECT review_key, sentence_index, array_to_string(products_mentioned, ';') AS products_mentioned
    FROM answers_a WHERE len(products_mentioned) > 0""", "answers_a"))
def products_mentioned(d: Domain):
    parsed = classify.parse_answers(d.stored("json", "a"))
    return classify.mentioned_products(parsed, d.products.select("product_name")).select(
        "review_key", *longs("sentence_index"), joined("products_mentioned"))


RETHRESHOLD_SQL = check_sql(f"""
    SELECT review_key, sentence_index, array_to_string(products_mentioned, ';') AS products_mentioned
    FROM ({_threshold_sql(0.8)}) WHERE error IS NULL""", "raw_a")


@query("rethreshold", RETHRESHOLD_SQL)
def rethreshold(d: Domain):
    catalogue = d.products.select("product_name")
    stored = classify.flatten_answers(d.stored("json", "a"), catalogue)
    return classify.rethreshold(stored.where("error IS NULL"), catalogue, 0.8).select(
        "review_key", *longs("sentence_index"), joined("products_mentioned"))


EXPLODE_SQL = check_sql(f"""
    SELECT question, count(*) AS answers, round(avg(confidence), 6) AS mean_confidence,
      round(avg(probability), 6) AS mean_probability, round(avg(score), 6) AS mean_score FROM (
      SELECT 'frustration' AS question, frustration AS score, NULL::DOUBLE AS probability,
        frustration_confidence AS confidence FROM raw_a WHERE NOT failed
      {' '.join(f"UNION ALL SELECT '{c}', NULL, NULL, {c}_confidence FROM raw_a WHERE NOT failed" for c in CHOICES)}
      {' '.join(f"UNION ALL SELECT '{f}', NULL, {f}, NULL FROM raw_a WHERE NOT failed" for f in FLAGS)}
      UNION ALL SELECT 'mentions', NULL, own_mention, NULL FROM raw_a WHERE NOT failed
      UNION ALL SELECT 'mentions', NULL, other_mention, NULL FROM raw_a WHERE NOT failed AND other_name <> product_name)
    GROUP BY 1""", "raw_a")


@query("explode_answers", EXPLODE_SQL)
def explode_answers(d: Domain):
    return answers_per_question(classify.explode_answers(d.stored("json", "a")))


def answers_per_question(decoded: DataFrame) -> DataFrame:
    kind = F.when(F.col("question").startswith(classify.MENTION), "mentions").otherwise(F.col("question"))
    return decoded.groupBy(kind.alias("question")).agg(
        F.count(F.lit(1)).alias("answers"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg("probability"), 6).alias("mean_probability"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("explode_answers_variant", EXPLODE_SQL)
def explode_answers_variant(d: Domain):
    return answers_per_question(answer_variants.explode_answers(d.stored("variant", "a")))


@query("rethreshold_variant", RETHRESHOLD_SQL)
def rethreshold_variant(d: Domain):
    stored = d.stored("variant", "a").where("error IS NULL")
    return answer_variants.rethreshold(stored, d.products.select("product_name"), 0.8).select(
        "review_key", *longs("sentence_index"), joined("products_mentioned"))


@query("flatten_answers_variant", check_sql(f"SELECT {SQL_FLAT} FROM answers_a", "answers_a"))
def flatten_answers_variant(d: Domain):
    flat = answer_variants.flatten_answers(d.stored("variant", "a"), d.products.select("product_name"))
    return flat.select(flat_columns())


@query("classified_sentences", check_sql("""
    SELECT review_id, sentence_index, sentence, problem_category, sentiment, language, round(frustration, 6) AS frustration,
      array_to_string(products_mentioned, ';') AS products_mentioned, error FROM classified""", "classified"))
def classified_sentences(d: Domain):
    return classify.attach_answers(d.sentences.drop("review_text"), d.answers("a")).select(
        "review_id", *longs("sentence_index"), "sentence", "problem_category", "sentiment", "language",
        *rounded(["frustration"]), joined("products_mentioned"), "error")


@query("usage_summary", check_sql("""
    SELECT 'scorer-a' AS models, count(*) AS answers, round_even(avg(latency_ms), 0) AS mean_latency_ms,
      sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
      count(*) FILTER (error IS NOT NULL) AS errors FROM answers_a""", "answers_a"))
def usage_summary(d: Domain):
    return classify.usage_summary(d.answers("a"))

