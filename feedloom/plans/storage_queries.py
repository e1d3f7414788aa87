"""Batches, commits, caches, growth and the stream: each writes to the shared folder and reads it back."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import classify, compare, incremental, texts
from feedloom.plans.classify_queries import joined, rounded
from feedloom.plans.domain import Domain
from feedloom.plans.domain_sql import check_sql
from feedloom.plans.feature_queries import FEATURE_COLUMNS, SQL_STAMP, feature_columns, longs, stamp
from feedloom.plans.quality_queries import SPECS
from feedloom.plans.lexical import ask
from feedloom.plans.registry import query
from feedloom.plans.text_queries import WRITER, briefs
from feedloom.schemas import KEY
from feedloom.session import fresh_path, materialise
from feedloom.sources import caches, dataset, growth, rollups, sketches
from feedloom.streaming import classify_stream as streaming
from feedloom.streaming import event_time
from feedloom.streaming import feature_stream as features

ORDERS = {"orders": SPECS["orders"]}
# the rules the given tables do keep; one customer may never have ordered and then has no signup
SOUND = {
    "customers": replace(SPECS["customers"], members={}, nullable=("signup_at",)),
    "orders": replace(SPECS["orders"], ranges={"order_total": (0, None, True)}),
    "products": replace(SPECS["products"], members={}, ranges={}),
    "order_lines": replace(SPECS["order_lines"], unique=(), ranges={"quantity": (1, None, False)}, row_checks={}),
    "reviews": replace(SPECS["reviews"], nullable=("order_line_id",), ranges={"rating": (1, 5, False)},
                       unique=("review_id",)),
    "review_texts": SPECS["review_texts"],
    "review_truth": replace(SPECS["review_truth"], ranges={"satisfaction": (0.0, 1.0, False)}),
}
HELD = ["order_customer", "line_order", "line_product", "order_after_signup", "review_customer", "review_product",
        "text_review"]
ORDER_SQL = f"order_id, customer_id, strftime(ordered_at, {SQL_STAMP}) AS ordered_at, order_total"


def order_columns():
    return ["order_id", "customer_id", stamp("ordered_at"), "order_total"]


@query("read_orders", check_sql(f"SELECT {ORDER_SQL} FROM placed", "placed"))
def read_orders(d: Domain):
    # both layouts at once: the first years as a whole table, the later ones as a committed batch
    path = fresh_path(d.spark, "orders")
    d.orders.where("batch_id <= 3").write.parquet(f"{path}/orders.parquet")
    later = d.orders.where("batch_id > 3")
    counts = dataset.write_batch({"orders": later}, 4, path, specs=ORDERS)
    dataset.write_commit(d.spark, path, batch_id=4, kind="advance", counts=counts)
    return dataset.read_dataset(d.spark, path, specs=ORDERS)["orders"].select(order_columns())


@query("write_dataset", check_sql("""
    SELECT 'customers' AS "table", count(*) AS rows FROM customers UNION ALL SELECT 'orders', count(*) FROM placed
    UNION ALL SELECT 'products', count(*) FROM products UNION ALL SELECT 'order_lines', count(*) FROM order_lines
    UNION ALL SELECT 'reviews', count(*) FROM reviews
    UNION ALL SELECT 'review_texts', count(*) FROM review_texts UNION ALL SELECT 'review_truth', count(*) FROM review_truth""",
    "customers", "placed", "products", "order_lines", "reviews", "review_texts", "review_truth"))
def write_dataset(d: Domain):
    # every table is checked on its own and against the others before anything is written; that the rules hold follows from
    # the ids of the tables given, so a broken one is stored beside them, not thrown
    path = fresh_path(d.spark, "dataset")
    dataset.write_dataset({name: d.tables[name] for name in SOUND}, path, specs=SOUND, rules=HELD, refuse=False)
    stored = dataset.read_dataset(d.spark, path, specs=SOUND)
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in stored.items()]
    return reduce(DataFrame.unionByName, counts)


@query("committed_batches", check_sql(f"""
    SELECT {ORDER_SQL}, batch_id::BIGINT AS batch_id FROM placed
    WHERE batch_id < (SELECT max(batch_id) FROM placed)""", "placed"))
def committed_batches(d: Domain):
    # every year is a batch; the last one was interrupted before its commit and stays invisible
    path = fresh_path(d.spark, "batches")
    years = [r.batch_id for r in d.orders.select("batch_id").distinct().orderBy("batch_id").collect()]
    for year in years:
        part = d.orders.where(F.col("batch_id") == year)
        counts = dataset.write_batch({"orders": part}, year, path, specs=ORDERS)
        if year < years[-1]:
            dataset.write_commit(d.spark, path, batch_id=year, kind="advance", counts=counts)
    return dataset.read_dataset(d.spark, path, specs=ORDERS)["orders"].select(*order_columns(), *longs("batch_id"))


def utc(day: str) -> datetime:
    return datetime.fromisoformat(day)


SETTINGS = {"start": "1995-01-01"}


# the rules across tables that the given tables keep; every batch is held against them before it is committed
GROWN_REVIEWS = replace(SPECS["reviews"], nullable=(*SPECS["reviews"].nullable, "order_line_id"),
                        ranges={k: v for k, v in SPECS["reviews"].ranges.items() if k != "batch_id"})
KEPT = ["order_customer", "order_after_signup", "review_customer"]


def grown(d: Domain) -> str:
    """A dataset grown in three steps: all customers up to a date, then two moves in time."""
    path = fresh_path(d.spark, "grown")
    source = {name: d.tables[name] for name in ("customers", "orders", "reviews")}
    specs = {"customers": SOUND["customers"], "orders": SOUND["orders"], "reviews": GROWN_REVIEWS}
    growth.init_dataset(d.spark, path, as_of=utc("1997-12-31"), settings=SETTINGS)
    growth.add_customers(d.spark, path, source, settings=SETTINGS, specs=specs, rules=KEPT)
    for day in ("1999-12-31", "1999-12-31", "2002-12-31"):  # the repeated date does nothing
        growth.advance(d.spark, path, source, to=utc(day), settings=SETTINGS, specs=specs, rules=KEPT)
    return path


STEP = ("CASE WHEN {0} <= TIMESTAMP '1997-12-31' THEN 1 WHEN {0} <= TIMESTAMP '1999-12-31' THEN 2 ELSE 3 END::BIGINT")


@query("batch_status", check_sql(f"""
    SELECT 1::BIGINT AS batch_id, 'add-customers' AS kind, 'customers' AS "table", count(*) AS rows FROM customers
    UNION ALL SELECT {STEP.format('ordered_at')}, CASE WHEN {STEP.format('ordered_at')} = 1 THEN 'add-customers'
      ELSE 'advance' END, 'orders', count(*) FROM placed GROUP BY 1, 2
    UNION ALL SELECT {STEP.format('reviewed_at')}, CASE WHEN {STEP.format('reviewed_at')} = 1 THEN 'add-customers'
      ELSE 'advance' END, 'reviews', count(*) FROM reviews GROUP BY 1, 2""", "customers", "placed", "reviews"))
def batch_status(d: Domain):
    return dataset.batch_status(d.spark, grown(d)).select(*longs("batch_id"), "kind", "table", "rows")


@query("grown_reviews", check_sql(f"""
    SELECT review_id, strftime(reviewed_at, {SQL_STAMP}) AS reviewed_at, {STEP.format('reviewed_at')} AS batch_id
    FROM reviews""", "reviews"))
def grown_reviews(d: Domain):
    specs = {name: SPECS[name] for name in ("customers", "orders", "reviews")}
    return dataset.read_dataset(d.spark, grown(d), specs=specs)["reviews"].select(
        "review_id", stamp("reviewed_at"), *longs("batch_id"))


SINCE, UNTIL, BORDER = utc("1997-06-30"), utc("2000-06-30"), utc("1999-02-01")


@query("time_slice", check_sql(f"""
    SELECT review_id, strftime(reviewed_at, {SQL_STAMP}) AS reviewed_at FROM reviews
    WHERE reviewed_at > TIMESTAMP '1997-06-30' AND reviewed_at <= TIMESTAMP '2000-06-30'""", "reviews"))
def time_slice(d: Domain):
    return incremental.time_slice(d.reviews, "reviewed_at", since=SINCE, until=UNTIL).select(
        "review_id", stamp("reviewed_at"))


@query("slice_equivalence", check_sql("""
    , steps AS (SELECT * FROM placed WHERE ordered_at > TIMESTAMP '1997-06-30' AND ordered_at <= TIMESTAMP '1999-02-01'
      UNION ALL SELECT * FROM placed WHERE ordered_at > TIMESTAMP '1999-02-01' AND ordered_at <= TIMESTAMP '2000-06-30'),
    once AS (SELECT * FROM placed WHERE ordered_at > TIMESTAMP '1997-06-30' AND ordered_at <= TIMESTAMP '2000-06-30')
    SELECT (SELECT count(*) FROM (SELECT * FROM steps EXCEPT ALL SELECT * FROM once)) AS only_first,
      (SELECT count(*) FROM (SELECT * FROM once EXCEPT ALL SELECT * FROM steps)) AS only_second""", "placed"))
def slice_equivalence(d: Domain):
    cut = lambda since, until: incremental.time_slice(d.orders, "ordered_at", since=since, until=until)
    return incremental.slice_equivalence(cut(SINCE, BORDER).unionByName(cut(BORDER, UNTIL)), cut(SINCE, UNTIL))


@query("missing_keys", check_sql("""
    SELECT order_id FROM placed WHERE ordered_at > TIMESTAMP '1999-02-01'""", "placed"))
def missing_keys(d: Domain):
    stored = incremental.time_slice(d.orders, "ordered_at", until=BORDER)
    return incremental.missing_keys(d.orders, stored, "order_id").select("order_id")


@query("late_reviews", check_sql("""
    SELECT DISTINCT review_id, r.batch_id::BIGINT AS review_batch, o.batch_id::BIGINT AS line_batch
    FROM reviews r JOIN order_lines l USING (order_line_id) JOIN placed o ON o.order_id = l.order_id
    WHERE o.batch_id < r.batch_id""", "reviews", "order_lines", "placed"))
def late_reviews(d: Domain):
    lines = d.order_lines.select("order_line_id", "order_id").join(d.orders.select("order_id", "batch_id"), "order_id")
    return incremental.late_reviews(d.reviews, lines).select("review_id", *longs("review_batch", "line_batch"))


@query("dry_run_report", check_sql("""
    SELECT 'orders' AS item, count(*)::DOUBLE AS value FROM placed WHERE ordered_at > TIMESTAMP '1999-02-01'
    UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE reviewed_at > TIMESTAMP '1999-02-01'
    UNION ALL SELECT item, round(value, 6) FROM (
      SELECT count(*)::DOUBLE AS reviews_to_write, sum(sentences)::DOUBLE AS sentences,
        sum(sentences) * 2750::DOUBLE AS classifier_tokens
      FROM briefs WHERE reviewed_at > TIMESTAMP '1999-02-01')
      UNPIVOT (value FOR item IN (reviews_to_write, sentences, classifier_tokens))""", "placed", "reviews", "briefs"))
def dry_run_report(d: Domain):
    new = {"orders": incremental.time_slice(d.orders, "ordered_at", since=BORDER),
           "reviews": incremental.time_slice(d.reviews, "reviewed_at", since=BORDER)}
    wanted = texts.review_briefs(new["reviews"], d.review_truth, d.products)
    estimate = texts.batch_estimate(wanted).select(F.col("reviews").alias("reviews_to_write"), "sentences",
                                                   "classifier_tokens")
    return incremental.dry_run_report(new, estimate)


SCORED_SQL = """
    SELECT review_key, sentence_index, round(frustration, 6) AS frustration, model, error FROM answers_a"""


def scored_columns():
    return ["review_key", *longs("sentence_index"), *rounded(["frustration"]), "model", "error"]


@query("classify_with_cache", check_sql(SCORED_SQL, "answers_a"))
def classify_with_cache(d: Domain):
    # a first run over the early reviews fills the cache; the second asks only for the rest and the failures
    path = fresh_path(d.spark, "answer_cache")
    sentences = materialise(d.sentences.drop("review_text"), "sentences")
    catalogue = d.products.select("product_name")
    scorer = classify.per_sentence(ask, model="scorer-a")
    partitions = d.spark.sparkContext.defaultParallelism
    early = incremental.time_slice(sentences, "reviewed_at", until=BORDER)
    caches.classify_sentences(early, catalogue, scorer, columns=[*KEY, "sentence"], cache_path=path, partitions=partitions)
    return caches.classify_sentences(sentences, catalogue, scorer, columns=[*KEY, "sentence"], cache_path=path,
                                     partitions=partitions).select(scored_columns())


@query("append_answers", check_sql("""
    SELECT model, count(*) AS answers, sum(input_tokens)::BIGINT AS input_tokens FROM (
      SELECT * FROM answers_a UNION ALL SELECT * FROM answers_b) WHERE error IS NULL GROUP BY 1""",
    "answers_a", "answers_b"))
def append_answers(d: Domain):
    path = fresh_path(d.spark, "answers")
    for answers in d.both_answers():
        caches.append_answers(answers, path)
    read = [caches.read_answers(d.spark, path, model=f"scorer-{salt}") for salt in ("a", "b")]
    return read[0].unionByName(read[1]).groupBy("model").agg(
        F.count(F.lit(1)).alias("answers"), F.sum("input_tokens").alias("input_tokens"))


@query("write_classified", check_sql("""
    SELECT review_id, sentence_index, sentence, problem_category, array_to_string(products_mentioned, ';')
      AS products_mentioned, error FROM classified""", "classified"))
def write_classified(d: Domain):
    path = fresh_path(d.spark, "classified")
    caches.write_classified(d.classified_by_review(), path)
    return caches.read_classified(d.spark, path).select(
        "review_id", *longs("sentence_index"), "sentence", "problem_category", joined("products_mentioned"), "error")


@query("saved_runs", check_sql("""
    SELECT run AS classifier, count(*) AS sentences, count(*) FILTER (error IS NOT NULL) AS failed,
      round(count(*) / any_value(seconds), 2) AS sentences_per_s
    FROM (SELECT 'a' AS run, 1200::DOUBLE AS seconds, error FROM answers_a
          UNION ALL SELECT 'b', 9000, error FROM answers_b) GROUP BY 1""", "answers_a", "answers_b"))
def saved_runs(d: Domain):
    path = fresh_path(d.spark, "runs")
    for salt, seconds, answers in zip("ab", (1200.0, 9000.0), d.both_answers()):
        caches.save_run(answers, path, run=salt, seconds=seconds, concurrency=8)
    results, runs = caches.load_runs(d.spark, path)
    return compare.speed(results, runs, sentences_in_dataset=1).select("classifier", "sentences", "failed",
                                                                       "sentences_per_s")


def echoing_write(row: dict) -> str:
    """A writer's call: it fails where the review was to be about safety."""
    if row["aspect"] == "safety":
        raise TimeoutError("busy")
    return f"{row['aspect']}: {row['sentences']} sentences"


@query("text_cache_append", check_sql("""
    SELECT review_id, CASE WHEN aspect <> 'safety' THEN aspect || ': ' || sentences || ' sentences' END AS review_text,
      language FROM briefs WHERE aspect <> 'safety'""", "briefs"))
def text_cache_append(d: Domain):
    path = fresh_path(d.spark, "texts")
    schema = caches.TEXT_DDL.replace("review_id STRING", "review_id BIGINT")
    prompted = texts.with_prompt(briefs(d), WRITER)
    for _ in range(2):  # the second run finds all but the failures stored
        todo = texts.texts_to_write(prompted, caches.read_texts(d.spark, path, schema))
        caches.append_texts(texts.write_texts(todo, echoing_write, model=WRITER), path)
    return texts.cached_texts(prompted, caches.read_texts(d.spark, path, schema)).select(
        "review_id", "review_text", "language")


@query("classify_stream", check_sql(SCORED_SQL, "answers_a"))
def classify_stream(d: Domain):
    source, sink = fresh_path(d.spark, "arriving"), fresh_path(d.spark, "stream")
    checkpoint = fresh_path(d.spark, "stream_checkpoint")
    ddl = "review_id BIGINT, product_name STRING, review_text STRING"
    arriving = d.texts.select("review_id", "product_name", "review_text", "reviewed_at")
    scorer = classify.per_sentence(ask, model="scorer-a")

    def run():
        streaming.classify_stream(
            d.spark, source, sink, checkpoint, reviews_ddl=ddl, catalogue=d.products.select("product_name"),
            scorer=scorer, columns=[*KEY, "sentence"], partitions=d.spark.sparkContext.defaultParallelism).awaitTermination()

    parts = [incremental.time_slice(arriving, "reviewed_at", until=BORDER),
             incremental.time_slice(arriving, "reviewed_at", since=BORDER)]
    for part in parts:
        part.drop("reviewed_at").write.mode("append").parquet(source, compression=streaming.TEXT_CODEC)
        run()
    streaming.retry_failed(d.spark, sink, catalogue=d.products.select("product_name"), scorer=scorer, columns=[*KEY, "sentence"])
    return streaming.stored_answers(d.spark, sink, columns=["frustration", "model", "error"]).select(scored_columns())


def arrived_events(d: Domain, source: str) -> None:
    """Orders and reviews as files of four periods; within and between neighbouring periods they arrive out of order. A
    last file moves the time on, as the next day of a running shop would."""
    events = features.events_of(d.orders, d.reviews)
    days = F.datediff("at", F.lit("1994-01-01").cast("date"))
    swap = F.pmod(F.xxhash64("event_id", "kind"), F.lit(60))  # up to two months before or after its neighbours
    period = F.least(F.greatest(F.floor((days + swap) / 730), F.lit(0)), F.lit(3))
    placed, path = events.withColumn("period", period), fresh_path(d.spark, "events")
    placed.write.partitionBy("period").parquet(path)  # a period is a folder, so that none is read for another
    stored = d.spark.read.schema(placed.schema).parquet(path)
    for p in range(4):
        stored.where(F.col("period") == p).drop("period").coalesce(1).write.mode("append").parquet(source)
    tick = stored.where("customer_id IS NOT NULL").select(
        F.lit(features.ORDER).alias("kind"), F.lit(-1).cast("bigint").alias("customer_id"),
        F.lit(-1).cast("bigint").alias("event_id"), F.expr("TIMESTAMP '2100-01-01'").alias("at"),
        F.lit(0).cast("bigint").alias("amount")).limit(1)
    tick.coalesce(1).write.mode("append").parquet(source)


@query("review_features_stream", check_sql(f"SELECT {FEATURE_COLUMNS} FROM features", "features"))
def review_features_stream(d: Domain):
    source, sink, checkpoint = (fresh_path(d.spark, n) for n in ("arriving_events", "features", "features_checkpoint"))
    arrived_events(d, source)
    features.feature_stream(d.spark, source, sink, checkpoint, key_type="BIGINT", files_per_batch=1).awaitTermination()
    return features.finished_features(d.spark, sink, d.customers, "BIGINT").select(feature_columns())


@query("problems_merged", check_sql("SELECT * FROM problems", "problems"))
def problems_merged(d: Domain):
    # early reviews come with the answers of another scorer, later ones follow, then the early answers are revised
    path = fresh_path(d.spark, "rollups")
    # both runs meet the sentences: split them once
    facts = materialise(d.sentences.select("review_id", *KEY, "product_name", "reviewed_at"), "sentences")
    by = {salt: materialise(classify.attach_answers(facts, answers), f"classified_{salt}")
          for salt, answers in zip("ab", d.both_answers("problem_category", "frustration"))}
    early = {salt: incremental.time_slice(df, "reviewed_at", until=BORDER) for salt, df in by.items()}
    later = incremental.time_slice(by["a"], "reviewed_at", since=BORDER)
    steps = [rollups.changed(None, early["b"]), rollups.changed(None, later), rollups.changed(early["b"], early["a"])]
    for batch, changes in enumerate(steps, 1):
        rollups.merge_problems(d.spark, changes, path, batch)
    return rollups.problems(d.spark, path)


SPREAD = {"p50": 0.5, "p95": 0.95}


def _sketched(d: Domain, rows: DataFrame, by: str, distinct: str, number: str) -> DataFrame:
    """Sketches of one batch per year, merged, beside the exact numbers; `rows` carry a time `reviewed_at`."""
    path, key = fresh_path(d.spark, "sketches"), by.split()[0]
    stored = materialise(rows.withColumn("batch", F.year("reviewed_at") - F.lit(1990)), "sketched_rows")
    for batch in sorted(r.batch for r in stored.where("batch IS NOT NULL").select("batch").distinct().collect()):
        one = stored.where(F.col("batch") == batch)
        sketches.write_batch(d.spark, sketches.sketched(one, [key], distinct=distinct, number=number), path, batch)
    found = sketches.estimates(sketches.merged(d.spark, path, by), SPREAD)
    return sketches.beside_exact(stored, found, [key], distinct=distinct, number=number, quantiles=SPREAD)


WITHIN = "true AS distinct_within, true AS p50_within, true AS p95_within"


@query("text_sketches", check_sql(f"""
    SELECT text_language, count(*) AS n, count(DISTINCT review_key) AS distinct_values, {WITHIN}
    FROM texts GROUP BY 1""", "texts"))
def text_sketches(d: Domain):
    rows = d.texts.select("text_language", "review_key", "reviewed_at", F.length("review_text").alias("size"))
    return _sketched(d, rows, "text_language STRING", "review_key", "size")


@query("latency_sketches", check_sql(f"""
    SELECT run, count(*) AS n, count(DISTINCT review_key) AS distinct_values, {WITHIN} FROM (
      SELECT 'a' AS run, s.review_key, a.latency_ms FROM sentences s JOIN answers_a a USING (review_key, sentence_index)
      UNION ALL SELECT 'b', s.review_key, b.latency_ms FROM sentences s JOIN answers_b b USING (review_key, sentence_index))
    GROUP BY 1""", "sentences", "answers_a", "answers_b"))
def latency_sketches(d: Domain):
    # latencies of the stand-in scorers follow from the lengths of sentences; they are no measurement
    # both runs meet the sentences: split them once
    at = materialise(d.sentences.select("review_key", "sentence_index", "reviewed_at"), "sentences")
    runs = [at.join(answers, KEY).withColumn("run", F.lit(salt)) for salt, answers in zip("ab", d.both_answers("latency_ms"))]
    return _sketched(d, reduce(DataFrame.unionByName, runs), "run STRING", "review_key", "latency_ms")


FAR = "TIMESTAMP '2100-01-01'"  # a row of this time, which no window of the results holds, moves the watermark on


def arriving(d: Domain, rows: DataFrame, name: str, end: dict[str, str]) -> DataFrame:
    """`rows` (with a time `at`) as a stream of one file per two years in order, then one of the last row `end`."""
    source = fresh_path(d.spark, name)
    stored = materialise(rows.withColumn("year", F.floor(F.year("at") / 2)), name)
    for year in sorted(r.year for r in stored.where("year IS NOT NULL").select("year").distinct().collect()):
        stored.where(F.col("year") == year).drop("year").coalesce(1).write.mode("append").parquet(source)
    last = [F.expr(end.get(c, "NULL")).cast(t).alias(c) for c, t in rows.dtypes]
    d.spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(source)
    return d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def finished(d: Domain, stream: DataFrame, name: str) -> DataFrame:
    sink = fresh_path(d.spark, name)
    event_time.run(stream, sink, fresh_path(d.spark, f"{name}_checkpoint")).awaitTermination()
    return d.spark.read.schema(stream.schema).parquet(sink)


def written_reviews(d: Domain) -> DataFrame:
    kinds = d.products.select("product_id", F.col("category").alias("product_category"))
    return d.reviews.join(kinds, "product_id").select(
        "review_id", "customer_id", "product_category", "rating", F.col("reviewed_at").cast("timestamp").alias("at"))


@query("review_windows_stream", check_sql(f"""
    SELECT strftime(time_bucket(INTERVAL 30 DAY, reviewed_at, TIMESTAMP '1970-01-01'), {SQL_STAMP}) AS window_start,
      product_category, count(*) AS reviews, sum(rating)::BIGINT AS stars, count(*) FILTER (rating <= 2) AS unhappy
    FROM (SELECT r.*, p.category AS product_category FROM reviews r JOIN products p USING (product_id)) GROUP BY 1, 2""",
    "reviews", "products"))
def review_windows_stream(d: Domain):
    stream = event_time.tumbling(arriving(d, written_reviews(d), "arriving_reviews", {"at": FAR}))
    return finished(d, stream, "windows").select(stamp("window_start"), "product_category", "reviews", "stars", "unhappy")


@query("review_sessions_stream", check_sql(f"""
    , marked AS (
      SELECT customer_id, reviewed_at, rating, coalesce(reviewed_at >= lag(reviewed_at) OVER w + INTERVAL 30 DAY, true) AS new
      FROM reviews JOIN products USING (product_id) WINDOW w AS (PARTITION BY customer_id ORDER BY reviewed_at)),
    numbered AS (
      SELECT *, sum(new::INT) OVER (PARTITION BY customer_id ORDER BY reviewed_at ROWS UNBOUNDED PRECEDING) AS session
      FROM marked)
    SELECT customer_id, strftime(min(reviewed_at), {SQL_STAMP}) AS session_start,
      strftime(max(reviewed_at) + INTERVAL 30 DAY, {SQL_STAMP}) AS session_end, count(*) AS reviews,
      min(rating)::BIGINT AS worst
    FROM numbered GROUP BY customer_id, session""", "reviews", "products"))
def review_sessions_stream(d: Domain):
    stream = event_time.sessions(arriving(d, written_reviews(d), "arriving_reviews", {"at": FAR, "customer_id": "-1"}))
    return finished(d, stream, "sessions").select("customer_id", stamp("session_start"), stamp("session_end"), "reviews",
                                                  *longs("worst"))


@query("reviews_with_orders_stream", check_sql("""
    SELECT doc_id AS review_id, CASE WHEN doc_id % 11 = 0 THEN 'no order' WHEN doc_id % 7 = 0 THEN 'another buyer' END AS violation
    FROM documents JOIN placed ON order_id = doc_id % (SELECT count(*) FROM orders)""", "placed"))
def reviews_with_orders_stream(d: Domain):
    # of the given reviews, every eleventh names an order that is not there and every seventh another customer
    n_orders = d.raw("orders").agg(F.count(F.lit(1))).scalar()
    orders = d.orders.select("order_id", "customer_id", F.col("ordered_at").cast("timestamp").alias("at"))
    reviews = d.reviews.select(
        "review_id", F.when(F.col("review_id") % 11 == 0, -F.col("review_id") - 2).otherwise(F.col("review_id") % n_orders).alias("order_id"),
        (F.col("customer_id") + (F.col("review_id") % 7 == 0).cast("int")).alias("customer_id"),
        F.col("reviewed_at").cast("timestamp").alias("at"))
    stream = event_time.reviews_with_orders(
        arriving(d, reviews, "arriving_reviews", {"at": FAR, "order_id": "-1"}),
        arriving(d, orders, "arriving_orders", {"at": FAR, "order_id": "-1"}), delay="800 days")
    return finished(d, stream, "reviews_with_orders").where("review_id IS NOT NULL")


# the given products as a CSV file with faults: words for prices, impossible dates, a missing name, a field too many
CATALOGUE = replace(SPECS["products"], ddl="product_id BIGINT, product_name STRING, category STRING, list_price DOUBLE, "
                                           "launched_on DATE", members={}, unique=(), nullable=(), patterns={},
                    ranges={"list_price": (950.0, None, True)})
FAULTS = {"price": "product_id % 13 = 0", "date": "product_id % 17 = 0", "name": "product_id % 19 = 0", "field": "product_id % 23 = 0"}


def catalogue_file(d: Domain) -> str:
    path = fresh_path(d.spark, "catalogue")
    fields = d.products.select(
        "product_id", F.when(F.expr(FAULTS["name"]), None).otherwise(F.col("product_name")).alias("product_name"), "category",
        F.when(F.expr(FAULTS["price"]), "n/a").otherwise(F.col("list_price").cast("string")).alias("list_price"),
        F.when(F.expr(FAULTS["date"]), "2021-13-45").otherwise(F.col("launched_on").cast("string")).alias("launched_on"))
    line = F.to_csv(F.struct(*fields.columns))
    fields.select(F.when(F.expr(FAULTS["field"]), F.concat(line, F.lit(",more"))).otherwise(line)).write.text(f"{path}/lines")
    # one file per task, each without the header, which is a file of its own beside them for the reader of names
    header = d.spark.createDataFrame([(",".join(fields.columns),)], "line STRING")
    whole = header.coalesce(1).unionByName(d.spark.read.text(f"{path}/lines").toDF("line").coalesce(1)).coalesce(1)
    whole.write.text(f"{path}/catalogue")
    return f"{path}/catalogue"


@query("catalogue_accepted", check_sql(f"""
    SELECT product_id, product_name, category, list_price, strftime(launched_on, '%Y-%m-%d') AS launched_on FROM products
    WHERE NOT ({' OR '.join(FAULTS.values())}) AND list_price > 950.0""", "products"))
def catalogue_accepted(d: Domain):
    accepted, _ = dataset.checked_catalogue(d.spark, catalogue_file(d), CATALOGUE)
    return accepted.withColumn("launched_on", F.date_format("launched_on", "yyyy-MM-dd"))


REASONS = {"the number of fields differs from the header''s": FAULTS["field"],
           "list_price is not double": f"{FAULTS['price']} AND NOT {FAULTS['field']}",
           "launched_on is not date": f"{FAULTS['date']} AND NOT {FAULTS['field']}",
           "product_name is present": f"{FAULTS['name']} AND NOT {FAULTS['field']}",
           "list_price is in range": f"list_price <= 950.0 AND NOT {FAULTS['price']} AND NOT {FAULTS['field']}"}


@query("catalogue_rejected", check_sql(f"""
    SELECT reason, count(*) AS lines FROM (SELECT unnest([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for r, c in REASONS.items())}])
      AS reason FROM products) WHERE reason IS NOT NULL GROUP BY 1""", "products"))
def catalogue_rejected(d: Domain):
    _, rejected = dataset.checked_catalogue(d.spark, catalogue_file(d), CATALOGUE)
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("lines"))
