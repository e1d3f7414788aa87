"""Two scorers against each other and against the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import classify, compare
from feedloom.plans.classify_queries import rounded, stated
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import check_sql
from feedloom.plans.feature_queries import longs
from feedloom.plans.registry import query
from feedloom.session import materialise

TARGET = 300

SAMPLE = f"""
    per_review AS (SELECT review_id, text_language, rating, count(*) AS n FROM sentences GROUP BY 1, 2, 3),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY text_language, rating ORDER BY md5('42:' || review_id)) - 1 AS position,
        greatest(floor(sum(n) OVER (PARTITION BY text_language, rating)
                       * ({TARGET} / (SELECT sum(n) FROM per_review)::DOUBLE)
                       / avg(n) OVER (PARTITION BY text_language, rating)), 1) AS quota FROM per_review),
    sample AS (SELECT s.* FROM sentences s SEMI JOIN (SELECT * FROM ranked WHERE position < quota) p USING (review_id))"""


def sample_sql(body: str) -> str:
    return check_sql("", "sentences").rstrip() + "," + SAMPLE + body


def stored_sentences(d: Domain):
    """Sampling reads the sentences several times: split them once."""
    return materialise(d.sentences.select("review_id", "text_language", "rating", "sentence_index", "sentence"),
                       "sentences")


@query("stratified_sample", sample_sql(" SELECT review_id, sentence_index, sentence FROM sample"))
def stratified_sample(d: Domain):
    return compare.stratified_sample(stored_sentences(d), TARGET).select(
        "review_id", *longs("sentence_index"), "sentence")


@query("sample_composition", sample_sql("""
    SELECT text_language, count(DISTINCT review_id) AS reviews, count(*) AS sentences FROM sample GROUP BY 1"""))
def sample_composition(d: Domain):
    return compare.sample_composition(compare.stratified_sample(stored_sentences(d), TARGET))


def _agree(question: str, condition: str) -> str:
    return (f"SELECT '{question}' AS question, round(avg(({condition})::INT), 3) AS agreement, count(*) AS sentences "
            "FROM pairs")


PAIRS = """,
    pairs AS (SELECT a.*, b.frustration AS f2, b.problem_category AS p2, b.language AS l2, b.sentiment AS s2,
        b.recommendation AS r2, b.churn_risk AS churn2, b.safety_concern AS safety2, b.suggestion AS suggestion2,
        b.competitor_mention AS competitor2, b.products_mentioned AS m2
      FROM answers_a a JOIN answers_b b USING (review_key, sentence_index) WHERE a.error IS NULL AND b.error IS NULL)
    """


@query("agreement", check_sql("", "answers_a", "answers_b").rstrip() + PAIRS + " UNION ALL ".join([
    _agree("frustration (within 1)", "abs(frustration - f2) <= 1"), _agree("problem_category", "problem_category = p2"),
    _agree("language", "language = l2"), _agree("sentiment", "sentiment = s2"),
    _agree("recommendation", "recommendation = r2"), _agree("churn_risk", "(churn_risk >= 0.5) = (churn2 >= 0.5)"),
    _agree("safety_concern", "(safety_concern >= 0.5) = (safety2 >= 0.5)"),
    _agree("suggestion", "(suggestion >= 0.5) = (suggestion2 >= 0.5)"),
    _agree("competitor_mention", "(competitor_mention >= 0.5) = (competitor2 >= 0.5)"),
    _agree("products_mentioned", "products_mentioned = m2")]))
def agreement(d: Domain):
    return compare.agreement(*d.both_answers(*compare.ASKED, "error"))


@query("disagreements", check_sql("", "sentences", "answers_a", "answers_b").rstrip() + PAIRS + """
    SELECT product_name, sentence, problem_category AS first, p2 AS second
    FROM pairs JOIN sentences USING (review_key, sentence_index) WHERE problem_category <> p2
    ORDER BY review_key, sentence_index, review_id LIMIT 10""")
def disagreements(d: Domain):
    return compare.disagreements(*d.both_answers("problem_category", "error"), d.sentences, "problem_category",
                                 names=("first", "second"), n=10)


def _accuracy_sql(salt: str) -> str:
    return f"""
    SELECT 'scorer-{salt}' AS classifier, (SELECT round(avg((heard = written)::INT), 3) FROM rows_{salt}) AS language,
      round(avg(found::INT), 3) AS issue_found, round(avg((main = aspect)::INT), 3) AS primary_issue,
      count(*) AS unhappy_reviews, count(main) AS primary_reviews
    FROM (SELECT review_id, any_value(aspect) AS aspect,
            coalesce(bool_or(problem_category = aspect) FILTER (problem_category <> 'none'), false) AS found,
            arg_max(problem_category, (frustration, -sentence_index)) FILTER (problem_category <> 'none') AS main
          FROM rows_{salt} WHERE satisfaction < 0.5 GROUP BY 1)"""


def _rows_sql(salt: str) -> str:
    return f""",
    rows_{salt} AS (SELECT s.review_id, s.sentence_index, a.language AS heard, a.problem_category, a.frustration,
        t.satisfaction, t.aspect, t.language AS written
      FROM sentences s JOIN answers_{salt} a USING (review_key, sentence_index) JOIN review_truth t USING (review_id)
      WHERE a.error IS NULL)"""


@query("accuracy", check_sql("", "sentences", "answers_a", "answers_b", "review_truth").rstrip()
       + _rows_sql("a") + _rows_sql("b") + _accuracy_sql("a") + " UNION ALL " + _accuracy_sql("b"))
def accuracy(d: Domain):
    a, b = (compare.accuracy(answers, d.sentences, d.review_truth).select(F.lit(f"scorer-{salt}").alias("classifier"), "*")
            for salt, answers in zip("ab", d.both_answers("language", "problem_category", "frustration", "error")))
    return a.unionByName(b)


def both_runs(d: Domain):
    columns = ["latency_ms", "input_tokens", "output_tokens", "error"]
    a, b = (answers.select(F.lit(salt).alias("run"), *columns) for salt, answers in zip("ab", d.both_answers(*columns)))
    return a.unionByName(b)


RUNS_SQL = """,
    results AS (SELECT 'a' AS run, * FROM answers_a UNION ALL SELECT 'b', * FROM answers_b)
    """


@query("speed", check_sql("", "sentences", "answers_a", "answers_b").rstrip() + RUNS_SQL + """
    SELECT r.run AS classifier, count(*) AS sentences, count(*) FILTER (error IS NOT NULL) AS failed,
      median(latency_ms) FILTER (error IS NULL) AS p50_ms, any_value(h.p95_ms) AS p95_ms, 8::BIGINT AS concurrency,
      round(count(*) / any_value(m.seconds), 2) AS sentences_per_s,
      round((SELECT count(*) FROM sentences) / (count(*) / any_value(m.seconds)) / 60, 1) AS dataset_minutes
    FROM results r JOIN (VALUES ('a', 1200.0::DOUBLE), ('b', 9000.0::DOUBLE)) m(run, seconds) USING (run)
    JOIN (SELECT run, list_sort(list(latency_ms))[round((count(*) - 1) * 0.95::DOUBLE)::BIGINT + 1] AS p95_ms
          FROM results WHERE error IS NULL GROUP BY 1) h USING (run)
    GROUP BY 1""")
def speed(d: Domain):
    runs = d.spark.createDataFrame([("a", 1200.0, 8), ("b", 9000.0, 8)], "run STRING, seconds DOUBLE, concurrency BIGINT")
    whole = d.sentences.agg(F.count(F.lit(1))).scalar()
    return compare.speed(both_runs(d), runs, sentences_in_dataset=whole)


@query("cost", check_sql("", "sentences", "answers_a", "answers_b", "customers").rstrip() + RUNS_SQL + """
    SELECT run AS classifier, round_even(avg(input_tokens), 0)::BIGINT AS input_tokens,
      round_even(avg(output_tokens), 0)::BIGINT AS output_tokens,
      round(CASE WHEN run = 'a' THEN avg(input_tokens) * 0.042::DOUBLE / 1e6 END, 9) AS usd_per_sentence,
      CASE WHEN run = 'a' THEN round(avg(input_tokens) * 0.042::DOUBLE / 1e6 * (
        SELECT round((SELECT count(*) FROM sentences) * 1000 / count(*)) FROM customers), 2) END AS usd_per_1000_customers
    FROM results WHERE error IS NULL GROUP BY 1""")
def cost(d: Domain):
    people = d.raw("customer").agg(F.count(F.lit(1))).scalar()
    scale = d.sentences.agg(F.round(F.count(F.lit(1)) * 1000 / people)).scalar()
    costed = compare.cost(both_runs(d), {"a": (0.042, 0.0), "b": (None, None)}, sentences_per_1000_customers=scale)
    return costed.select("classifier", "input_tokens", "output_tokens", *rounded(["usd_per_sentence"], 9),
                         "usd_per_1000_customers")


@query("prompt_tokens", check_sql("""
    SELECT count(*) AS sentences, round_even(sum(length(state)) / 4, 0)::BIGINT AS prompt_tokens FROM states""", "states"))
def prompt_tokens(d: Domain):
    return compare.prompt_tokens(stated(d), classify.distinct_reviews(d.texts))
