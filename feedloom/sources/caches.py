"""Stored answers, stored texts and stored runs. All are append-only; nothing older is rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.fixed_values import QUESTION_SET_VERSION, YES_THRESHOLD
from feedloom.operators.answer_variants import with_variant
from feedloom.operators.classify import Scorer, cache_misses, flatten_answers, score_sentences, valid_answers
from feedloom.schemas import ANSWERS_DDL, KEY, TEXT_DDL, VARIANTS_DDL, conform
from feedloom.session import TEXT_CODEC, kept_together, materialise
from feedloom.sources.dataset import read_or_none

ANSWER_PARTITIONS = ["model", "question_set_version"]


def append_answers(answers: DataFrame, path: str) -> None:
    """Store the answers that succeeded; failures are left to the next run. Runs a job."""
    conform(answers, ANSWERS_DDL).where("error IS NULL").write.mode("append") \
        .partitionBy(*ANSWER_PARTITIONS).parquet(path)


def append_variants(raw: DataFrame, path: str, version: str = QUESTION_SET_VERSION) -> None:
    """Store scorer output that succeeded with its answers as VARIANT, parsed here and nowhere else. Runs a job."""
    with_variant(raw.where("error IS NULL")).withColumn("question_set_version", F.lit(version)) \
        .write.mode("append").partitionBy(*ANSWER_PARTITIONS).parquet(path)


def read_variants(spark: SparkSession, path: str, *, version: str = QUESTION_SET_VERSION,
                  model: str | None = None) -> DataFrame:
    """Stored VARIANT answers of a version and, if named, a model; no rows where nothing was stored. A key stored by
    several runs comes back once, always the same: by model, latency and answer."""
    schema = StructType.fromDDL(VARIANTS_DDL)
    found = read_or_none(spark, path, schema)
    if found is None:
        return spark.createDataFrame([], schema)
    usable = found.where(F.col("question_set_version") == version)
    if model is not None:
        usable = usable.where(F.col("model") == model)
    # a variant has no order: its JSON text decides between equals, but only the variant is kept
    first = F.min_by(F.struct(*schema.names), F.struct("model", "latency_ms", F.to_json("answers")))
    return usable.groupBy(*KEY).agg(first.alias("first")).select("first.*")


def read_answers(spark: SparkSession, path: str, *, version: str = QUESTION_SET_VERSION,
                 model: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Stored answers that may be reused, one per key, or only those of `keys`.

    Version and model are folders, so others are not read.
    """
    schema = StructType.fromDDL(ANSWERS_DDL)
    found = read_or_none(spark, path, schema)
    if found is None:
        return spark.createDataFrame([], schema)
    usable = conform(valid_answers(found, version, model), ANSWERS_DDL)
    if keys is not None:
        usable = usable.join(keys.select(*KEY), KEY, "left_semi")
    return one_per_key(usable)


def one_per_key(answers: DataFrame) -> DataFrame:
    """One row per key, where several runs stored one: always the same, by model, latency and answer."""
    first = F.min_by(F.struct("*"), F.struct("model", "latency_ms", "answers_json")).alias("first")
    return answers.groupBy(*KEY).agg(first).select("first.*")


def classify_sentences(sentences: DataFrame, catalogue: DataFrame, scorer: Scorer, *, columns: list[str],
                       cache_path: str | None = None, model: str | None = None, partitions: int | None = None,
                       threshold: float = YES_THRESHOLD) -> DataFrame:
    """One answer row per distinct key of `sentences`: stored ones reused, the others scored now and stored.

    Runs jobs. Fresh answers are written before anything reads them, so a lost executor never makes the
    scorer run again for what later steps need. Failures are returned, but not stored.
    """
    spark = sentences.sparkSession
    schema = StructType.fromDDL(ANSWERS_DDL)
    # written before the append below, so that it does not see this run's answers
    known = materialise(read_answers(spark, cache_path, model=model, keys=sentences), "known_answers") \
        if cache_path else spark.createDataFrame([], schema)
    asked = cache_misses(sentences, known)
    raw = materialise(score_sentences(asked, scorer, columns=columns, partitions=partitions), "raw_answers")
    fresh = materialise(flatten_answers(raw, catalogue, threshold), "fresh_answers")
    if cache_path:
        append_answers(fresh, cache_path)
    return known.unionByName(fresh)


def append_texts(texts: DataFrame, path: str) -> None:
    """Store written texts; rows with an error are left out. Runs a job."""
    ok = texts.where("error IS NULL") if "error" in texts.columns else texts
    ok.select([part.split()[0] for part in TEXT_DDL.split(", ")]).write.mode("append").parquet(path)


def read_texts(spark: SparkSession, path: str, schema: str = TEXT_DDL) -> DataFrame:
    """Every text ever stored."""
    declared = StructType.fromDDL(schema)
    found = read_or_none(spark, path, declared)
    return spark.createDataFrame([], declared) if found is None else found


def write_classified(classified: DataFrame, path: str) -> None:
    """The flat classified sentences, without raw JSON and without the review text on every row. Runs a job."""
    with kept_together(classified.sparkSession):
        classified.drop("answers_json", "review_text").write.mode("overwrite").parquet(path, compression=TEXT_CODEC)


def read_classified(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


RUN_META = "name STRING, seconds DOUBLE, concurrency BIGINT"


def save_run(results: DataFrame, path: str, *, run: str, seconds: float, concurrency: int) -> None:
    """Keep a timed run, so that comparing again does not score again. Runs jobs."""
    results.drop("run").write.mode("overwrite").parquet(f"{path}/results/run={run}")
    results.sparkSession.createDataFrame([(run, float(seconds), concurrency)], RUN_META).coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/runs/run={run}")


def load_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results with a `run` column, one row (run, seconds, concurrency) per run)."""
    runs = spark.read.parquet(f"{path}/runs").select(F.col("name").alias("run"), "seconds", "concurrency")
    return spark.read.parquet(f"{path}/results"), runs
