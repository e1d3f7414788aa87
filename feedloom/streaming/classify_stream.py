"""Arriving reviews, classified as they come: split, drop what is answered, score, store, commit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from feedloom.functions.keys import content_key
from feedloom.operators.classify import Scorer, cache_misses, flatten_answers, score_sentences
from feedloom.operators.sentences import split_sentences
from feedloom.schemas import ANSWERS_DDL, KEY, conform
from feedloom.session import TEXT_CODEC, materialise
from feedloom.sources.dataset import committed, read_commits, read_or_none, write_commit

SENTENCE_COLUMNS = ["review_id", "review_key", "product_name", "sentence_index", "sentence_count", "sentence"]


def committed_answers(spark: SparkSession, sink: str, before: int | None = None) -> DataFrame:
    """Every stored answer of committed batches, or of those before one."""
    schema = StructType.fromDDL(ANSWERS_DDL).add("batch_id", IntegerType())
    found = read_or_none(spark, f"{sink}/answers", schema)
    if found is None:
        return spark.createDataFrame([], schema)
    batches = committed(spark, sink)
    return found.join(batches if before is None else batches.where(F.col("batch_id") < before), "batch_id",
                      "left_semi").select(*schema.names)


def stored_answers(spark: SparkSession, sink: str, *, before: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """One answer per key of committed batches, or of those before one: the earliest that succeeded, else a failure. Only
    `columns`, besides the key, are gathered if they are named."""
    rows = committed_answers(spark, sink, before)
    wanted = rows.columns if columns is None else list(dict.fromkeys([*KEY, *columns]))
    # a scorer answers a key once in a batch; of several answers of a batch, equal in model and latency, a hash decides
    order = F.struct(F.col("error").isNotNull(), F.col("batch_id"), "model", "latency_ms", F.hash("answers_json"), "error")
    values = [c for c in wanted if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*values), order).alias("first")).select(
        *[c if c in KEY else f"first.{c}" for c in wanted])


def stored_sentences(spark: SparkSession, sink: str, *, before: int | None = None) -> DataFrame | None:
    """Sentences of committed batches, or of those before one; None before the first."""
    try:
        found = spark.read.parquet(f"{sink}/sentences")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    batches = committed(spark, sink)
    return found.join(batches if before is None else batches.where(F.col("batch_id") < before), "batch_id", "left_semi")


def still_failed(spark: SparkSession, sink: str, *, besides: int | None = None) -> DataFrame | None:
    """One sentence per key whose every stored answer is a failure; None before the first batch.

    Every batch asks again for all open failures and stores those that remain, so the list of the last committed batch
    (besides one that is run again) is complete, and no older batch is read.
    """
    commits = read_commits(spark, sink) if besides is None else read_commits(spark, sink).where(F.col("batch_id") != besides)
    last = commits.orderBy(F.desc("created_at"), F.desc("batch_id")).select("batch_id").first()
    return None if last is None else spark.read.parquet(f"{sink}/failures/batch_id={last.batch_id}")


def to_ask(reviews: DataFrame, settled: DataFrame, partitions: int | None = None) -> DataFrame:
    """The sentences of keyed reviews whose keys are not among the `settled` ones, one row per key. Reviews without a key
    are left out: they are no copies of each other.

    Equal keys are equal texts, so a review travels whole, once, to where its key is, and is split there: its sentences
    are spread over as many tasks as scoring asks for without a shuffle of their own."""
    review = F.struct("review_id", "product_name", "review_text").alias("review")
    known = settled.where("review_key IS NOT NULL").select(
        "review_key", F.lit(None).cast(reviews.select(review).schema["review"].dataType).alias("review"), "sentence_index")
    rows = reviews.where("review_key IS NOT NULL").select(
        "review_key", review, F.lit(None).cast("int").alias("sentence_index")).unionByName(known)
    met = rows.repartition(partitions, "review_key") if partitions else rows
    # a settled key has no review, and an order that is null is never the least
    order = F.when(F.col("review").isNotNull(), F.struct(F.col("review.review_id").isNull(), F.col("review.review_id")))
    firsts = met.groupBy("review_key").agg(F.min_by("review", order).alias("first"),
                                           F.collect_set("sentence_index").alias("settled"))
    return split_sentences(firsts.where("first IS NOT NULL").select("review_key", "first.*", "settled")) \
        .where(~F.array_contains("settled", F.col("sentence_index"))).select(SENTENCE_COLUMNS)


def scored(asked: DataFrame, scorer: Scorer, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Answers of a scorer, stored; a sentence that failed comes back beside its error, so that none is looked for. Runs a
    job."""
    beside = [c for c in SENTENCE_COLUMNS if c not in KEY]
    return materialise(score_sentences(asked, scorer, columns=columns, partitions=partitions, beside_errors=beside),
                       "stream_raw")


def store_scored(raw: DataFrame, catalogue: DataFrame, sink: str, batch: int) -> int:
    """Write a batch's answers and the sentences that failed; the number of answers. Runs jobs."""
    seen = Observation()
    conform(flatten_answers(raw, catalogue, stored=True), ANSWERS_DDL).observe(seen, F.count(F.lit(1)).alias("n")) \
        .write.mode("overwrite").parquet(f"{sink}/answers/batch_id={batch}")
    raw.where("error IS NOT NULL AND review_key IS NOT NULL AND sentence IS NOT NULL").select(SENTENCE_COLUMNS) \
        .write.mode("overwrite").parquet(f"{sink}/failures/batch_id={batch}", compression=TEXT_CODEC)
    return seen.get["n"]


def retry_failed(spark: SparkSession, sink: str, *, catalogue: DataFrame, scorer: Scorer, columns: list[str],
                 partitions: int | None = None) -> int:
    """Ask again for every sentence that has failed so far, also when no review arrives; the number asked. Runs jobs.

    A retry is a batch of its own, numbered downwards from -1, so that it never meets a batch of the stream.
    """
    failed = still_failed(spark, sink)
    if failed is None:
        return 0
    asked = materialise(failed, "stream_retry")
    n = asked.count()
    if n:
        batch = min(0, read_commits(spark, sink).agg(F.min("batch_id")).first()[0]) - 1
        store_scored(scored(asked, scorer, columns, partitions), catalogue, sink, batch)
        write_commit(spark, sink, batch_id=batch, kind="retry", counts={"sentences": 0, "answers": n})
    return n


def classify_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, *, reviews_ddl: str,
                    catalogue: DataFrame, scorer: Scorer, columns: list[str], partitions: int | None = None,
                    files_per_batch: int = 1000) -> StreamingQuery:
    """Classify every review that has arrived in `source` since the last run, then stop.

    The checkpoint says which files were taken, so each is taken once. A batch writes into its own
    folder and is committed last: if it is run again after a failure it replaces that folder, and it
    looks for known answers only in earlier batches, never in its own. Every batch also asks again for the
    sentences that have failed before; `retry_failed` does so without a new review.
    """
    arriving = spark.readStream.schema(reviews_ddl).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def process(reviews: DataFrame, epoch: int) -> None:
        keyed = reviews.withColumn("review_key", content_key("product_name", "review_text"))
        place, seen = f"{sink}/sentences/batch_id={epoch}", Observation()
        split_sentences(keyed).select(SENTENCE_COLUMNS).observe(seen, F.count(F.lit(1)).alias("n")) \
            .write.mode("overwrite").parquet(place, compression=TEXT_CODEC)
        answered = committed_answers(spark, sink, epoch).where("error IS NULL").select(*KEY)
        failed = still_failed(spark, sink, besides=epoch)
        settled = answered if failed is None else answered.unionByName(failed.select(*KEY))
        raw = scored(to_ask(keyed, settled, partitions), scorer, columns)  # spread already
        again = spark.read.parquet(place).where("review_key IS NULL")
        asked = materialise(cache_misses(again if failed is None else again.unionByName(failed), answered), "stream_asked")
        raw = raw.unionByName(scored(asked, scorer, columns, partitions))
        answers = store_scored(raw, catalogue, sink, epoch)
        write_commit(spark, sink, batch_id=epoch, kind="classify",
                     counts={"sentences": seen.get["n"], "answers": answers})

    return (arriving.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
