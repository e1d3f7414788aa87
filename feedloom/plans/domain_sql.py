"""The views of `domain` as SQL, for checking: each entry is one WITH clause and what it builds on."""

from __future__ import annotations

from feedloom.fixed_values import CHOICES, FLAGS, QUESTION_SET_VERSION
from feedloom.plans.domain import ASPECTS, FIRST_YEAR, LANGUAGES
from feedloom.plans.lexical import DENSITY_CUES, cues, sql_choice, sql_density, sql_hits, sql_words

WHITESPACE = r"[\t-\r \x{85}\p{Z}]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def clipped(expr: str, top: str = "1") -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN greatest(0::DOUBLE, least({top}::DOUBLE, {expr})) END"


def cents(expr: str) -> str:
    return f"round({expr}::DECIMAL(18,6), 2)::DOUBLE"


def split_array(column: str) -> str:
    flat = f"regexp_replace({column}, '{WHITESPACE}', ' ', 'g')"
    marked = rf"regexp_replace({flat}, '([.!?]+) |([。！？]+) ?', '\1\2' || chr(31), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: trim(s)), "
            "lambda s: length(s) > 0)")


def raw_sql(salt: str) -> str:
    labels = {c: sql_choice(c, salt) for c in CHOICES}
    columns = [f"{sql_density('frustration', salt)} * 4.4::DOUBLE - 0.2::DOUBLE AS frustration",
               f"({sql_hits(cues(DENSITY_CUES['frustration'], salt))} + 1)::DOUBLE / (n + 1)::DOUBLE * 1.1::DOUBLE "
               "- 0.05::DOUBLE AS frustration_confidence"]
    columns += [f"{label} AS {c}" for c, (label, _) in labels.items()]
    columns += [f"{lead} * 1.1::DOUBLE - 0.05::DOUBLE AS {c}_confidence" for c, (_, lead) in labels.items()]
    columns += [f"{sql_density(f, salt)} * 1.2::DOUBLE - 0.1::DOUBLE AS {f}" for f in FLAGS]
    return f"""
    SELECT k.*, o.product_name AS other_name FROM (
      SELECT review_key, sentence_index, product_name, {", ".join(columns)},
        {sql_density('other_mention', salt)} AS other_mention,
        floor((('0x' || substr(md5(sentence), 1, 8))::BIGINT / 4294967296::DOUBLE)
              * (SELECT count(*) FROM part))::BIGINT AS other_id,
        {sql_density('own_mention', salt)} AS own_mention,
        length(sentence)::BIGINT * 13 % 4900 + 100 AS latency_ms, len(words) < 2 AS failed,
        length(sentence)::BIGINT + 2600 AS input_tokens, len(words)::BIGINT * 3 AS output_tokens
      FROM (SELECT *, {sql_words('sentence')} AS words, greatest(len({sql_words('sentence')}), 1) AS n
            FROM (SELECT review_key, sentence_index, min(product_name) AS product_name, min(sentence) AS sentence
                  FROM sentences GROUP BY ALL))
    ) k LEFT JOIN products o ON o.product_id = k.other_id"""


def answers_sql(salt: str) -> str:
    ok = lambda expr, name: f"CASE WHEN NOT failed THEN {expr} END AS {name}"
    columns = [ok(clipped("frustration", "4"), "frustration"),
               ok(clipped("frustration_confidence"), "frustration_confidence")]
    columns += [ok(c, c) for c in CHOICES]
    columns += [ok(clipped(f"{c}_confidence"), f"{c}_confidence") for c in CHOICES]
    columns += [ok(clipped(f), f) for f in FLAGS]
    mentions = ("list_sort(list_distinct(list_filter([CASE WHEN own_mention >= 0.5 THEN product_name END, "
                "CASE WHEN other_mention >= 0.5 AND other_name <> product_name THEN other_name END], "
                "lambda m: m IS NOT NULL)))")
    return f"""
    SELECT review_key, sentence_index, {', '.join(columns)}, {ok(mentions, 'products_mentioned')},
      {ok(text('scorer-' + salt), 'model')}, '{QUESTION_SET_VERSION}' AS question_set_version,
      {ok('input_tokens', 'input_tokens')}, {ok('output_tokens', 'output_tokens')}, latency_ms,
      CASE WHEN failed THEN 'TimeoutError: busy' END AS error
    FROM raw_{salt}"""


ANSWER_COLUMNS = ", ".join(
    f"a.{c}" for c in ["frustration", "frustration_confidence", *CHOICES, *[f"{c}_confidence" for c in CHOICES],
                       *FLAGS, "products_mentioned", "model", "question_set_version", "input_tokens",
                       "output_tokens", "latency_ms", "error"])

SHIFT = 1 << 40

VIEWS: dict[str, tuple[list[str], str]] = {
    "customers": ([], """
    SELECT c.c_custkey AS customer_id, c.c_name, n.n_name AS country,
      CASE WHEN c.c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
      DATE '1950-01-01' + (c.c_custkey % 14000)::INT AS date_of_birth,
      f.first_order - INTERVAL 30 DAY AS signup_at
    FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) f ON f.o_custkey = c.c_custkey"""),
    "products": ([], """
    SELECT p_partkey AS product_id, p_name || ' ' || p_partkey AS product_name, p_type AS category,
      p_brand || ' ' || p_name AS description, p_brand AS brand, p_retailprice AS list_price,
      DATE '1995-01-01' + (p_partkey % 400)::INT AS launched_on
    FROM part"""),
    "placed": ([], f"""
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ordered_at, o_totalprice AS order_total,
      year(o_orderdate) - {FIRST_YEAR} AS batch_id FROM orders"""),
    "order_lines": ([], """
    SELECT l_orderkey * 8 + l_linenumber AS order_line_id, l_orderkey AS order_id, l_partkey AS product_id,
      l_quantity::INT AS quantity, floor(l_extendedprice * 100 / l_quantity) / 100 AS unit_price,
      l_extendedprice AS line_total FROM lineitem"""),
    "reviews": (["placed"], f"""
    SELECT d.doc_id AS review_id, o.customer_id,
      coalesce(f.line % {SHIFT}, d.doc_id % (SELECT count(*) FROM part)) AS product_id,
      o.order_id * 8 + (f.line // {SHIFT}) AS order_line_id,
      o.ordered_at + to_days((d.doc_id % 60)::INT) AS reviewed_at, (d.doc_id % 5 + 1)::INT AS rating,
      year(o.ordered_at + to_days((d.doc_id % 60)::INT)) - {FIRST_YEAR} AS batch_id
    FROM documents d JOIN placed o ON o.order_id = d.doc_id % (SELECT count(*) FROM orders)
    LEFT JOIN (SELECT l_orderkey, min(l_linenumber::BIGINT * {SHIFT} + l_partkey) AS line FROM lineitem GROUP BY 1) f
      ON f.l_orderkey = o.order_id"""),
    "review_texts": ([], f"""
    SELECT doc_id AS review_id, text AS review_text,
      CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())} ELSE 'other' END AS language,
      source AS model FROM documents"""),
    "review_truth": (["review_texts"], f"""
    SELECT l.doc_id AS review_id, 0.25::DOUBLE + l.quality * 0.5::DOUBLE - l.toxic * 0.2::DOUBLE AS satisfaction,
      ({listed(ASPECTS)})[(l.doc_id % {len(ASPECTS)})::INT + 1] AS aspect, t.language
    FROM labels l JOIN review_texts t ON t.review_id = l.doc_id"""),
    "features": (["customers", "placed", "reviews"], """
    SELECT r.review_id, r.customer_id, date_diff('second', c.signup_at, r.reviewed_at) / 86400::DOUBLE AS tenure_days,
      round(coalesce(o.lifetime_revenue, 0), 2) AS lifetime_revenue, coalesce(o.order_count, 0) AS order_count,
      date_diff('second', o.last_order_at, r.reviewed_at) / 86400::DOUBLE AS days_since_last_order,
      coalesce(p.previous_reviews, 0) AS previous_reviews,
      floor(date_diff('day', c.date_of_birth, r.reviewed_at::DATE) / 365.25::DOUBLE)::INT AS age, c.gender, c.country
    FROM reviews r JOIN customers c USING (customer_id)
    LEFT JOIN (SELECT r.review_id, sum(e.order_total) AS lifetime_revenue, count(*) AS order_count,
                 max(e.ordered_at) AS last_order_at
               FROM reviews r JOIN placed e ON e.customer_id = r.customer_id AND e.ordered_at < r.reviewed_at
               GROUP BY 1) o USING (review_id)
    LEFT JOIN (SELECT r.review_id, count(*) AS previous_reviews
               FROM reviews r JOIN reviews e ON e.customer_id = r.customer_id AND e.reviewed_at < r.reviewed_at
               GROUP BY 1) p USING (review_id)"""),
    "texts": (["reviews", "review_texts", "products"], """
    SELECT r.review_id, substr(sha1(p.product_name || chr(31) || t.review_text), 1, 12) AS review_key, r.customer_id,
      r.product_id, p.product_name, p.category AS product_category, r.rating, r.reviewed_at, t.review_text,
      t.language AS text_language, t.model AS text_model
    FROM reviews r JOIN review_texts t USING (review_id) JOIN products p USING (product_id)"""),
    "loaded": (["texts", "features"], """
    SELECT t.*, f.tenure_days, f.lifetime_revenue, f.order_count, f.days_since_last_order, f.previous_reviews, f.age,
      f.gender, f.country FROM texts t JOIN features f USING (review_id)"""),
    "sentences": (["texts"], f"""
    SELECT * EXCLUDE (pieces), len(pieces) AS sentence_count, unnest(pieces) AS sentence,
      unnest(range(len(pieces))) AS sentence_index
    FROM (SELECT * EXCLUDE (review_text), {split_array('review_text')} AS pieces FROM texts)"""),
    "raw_a": (["sentences", "products"], raw_sql("a")),
    "raw_b": (["sentences", "products"], raw_sql("b")),
    "answers_a": (["raw_a"], answers_sql("a")),
    "answers_b": (["raw_b"], answers_sql("b")),
    "classified": (["sentences", "answers_a"], f"""
    SELECT s.*, {ANSWER_COLUMNS} FROM sentences s LEFT JOIN answers_a a USING (review_key, sentence_index)"""),
    "rolled": (["classified"], """
    SELECT review_id, count(*) AS sentences, max(frustration) AS peak_frustration, avg(frustration) AS mean_frustration,
      coalesce(list_sort(list(DISTINCT problem_category) FILTER (problem_category <> 'none')), []) AS problems,
      coalesce(list_sort(list_distinct(flatten(list(products_mentioned) FILTER (products_mentioned IS NOT NULL)))), []) AS mentioned,
      coalesce(bool_or(churn_risk >= 0.5), false) AS churn_risk,
      coalesce(bool_or(safety_concern >= 0.5), false) AS safety_concern,
      coalesce(bool_or(suggestion >= 0.5), false) AS suggestion,
      coalesce(bool_or(competitor_mention >= 0.5), false) AS competitor_mention,
      count(*) FILTER (sentiment = 'positive') AS positive_sentences,
      count(*) FILTER (sentiment = 'negative') AS negative_sentences,
      coalesce(arg_max(problem_category, (frustration, -sentence_index)) FILTER (problem_category <> 'none'),
               'no_issue') AS primary_issue
    FROM classified GROUP BY 1"""),
    "view": (["rolled", "loaded"], """
    SELECT l.* EXCLUDE (review_text), r.* EXCLUDE (review_id),
      CASE WHEN positive_sentences > negative_sentences THEN 'positive'
           WHEN negative_sentences > positive_sentences THEN 'negative' ELSE 'mixed' END AS text_sentiment,
      CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'mixed' ELSE 'positive' END AS star_sentiment,
      CASE WHEN churn_risk OR peak_frustration >= 3.0 THEN 'At risk' WHEN peak_frustration >= 2.0 THEN 'Frustrated'
           ELSE 'Satisfied' END AS risk_tier
    FROM loaded l JOIN rolled r USING (review_id)"""),
    "people": (["view"], """
    SELECT * EXCLUDE (position) FROM (
      SELECT *, count(*) OVER (PARTITION BY customer_id) AS reviews_written,
        row_number() OVER (PARTITION BY customer_id ORDER BY reviewed_at DESC, review_id DESC) AS position
      FROM view) WHERE position = 1"""),
    "links": (["view"], """
    SELECT 'sentiment' AS source_level, text_sentiment AS source, 'category' AS target_level, product_category AS target,
      text_sentiment AS sentiment, count(*) AS reviews FROM view GROUP BY ALL
    UNION ALL SELECT 'category', product_category, 'product', product_name, text_sentiment, count(*) FROM view GROUP BY ALL
    UNION ALL SELECT 'product', product_name, 'issue', primary_issue, text_sentiment, count(*) FROM view GROUP BY ALL"""),
    "problems": (["classified"], f"""
    SELECT product_name, problem_category, count(*) AS sentences, count(DISTINCT review_id) AS reviews,
      {cents('avg(frustration)')} AS mean_frustration
    FROM classified WHERE problem_category <> 'none' GROUP BY 1, 2"""),
}


def needed(names: list[str], known: dict[str, tuple[list[str], str]]) -> list[str]:
    """`names` with everything they build on, parents first."""
    ordered: list[str] = []
    for name in names:
        for n in [*needed(known[name][0], known), name]:
            if n not in ordered:
                ordered.append(n)
    return ordered


def check_sql(body: str, *views: str) -> str:
    """`body` with the WITH clauses of the views it reads."""
    if not views:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in needed(list(views), VIEWS)) + "\n" + body
