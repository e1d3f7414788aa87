"""One query per operator, over the whole of its intended table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import (
    ball_codes,
    chat,
    decontaminate,
    html_text,
    language,
    language_model,
    line_dedup,
    minhash,
    neighbours,
    oracles,
    packing,
    phrases,
    suffix_dedup,
    url_reputation,
)
from feedloom.llm.common import read


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words_per_shingle=3, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text; those of which nothing is left are not listed."""
    docs = read(spark, sf_dir, "documents")
    return line_dedup.without_passages(docs).select("doc_id", "text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _remainder(modulus: int):
    """crc32 of the doc_id as text, modulo; a null doc_id has remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", _remainder(4) == 2)
    model = language.train(docs.filter("not held_out"))
    return (language.label(docs.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans")))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", _remainder(7) == 2)
    return language_model.score(docs)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "bucket")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_turns(*chat.pairs_from_replies(read(spark, sf_dir, "conversations")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its number says low quality or toxic."""
    labels = read(spark, sf_dir, "labels").dropna(subset=["doc_id", "quality", "toxic"])
    outcomes = labels.select(F.col("doc_id").alias("page_id"),
                             ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_reputation.judge(read(spark, sf_dir, "pages"), outcomes).drop("bad_bound")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), least=100, longest=5, first=2000)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = ball_codes.compress(read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)
    return ball_codes.with_label_error(codes).withColumn("codebooks_sha256", F.lit(ball_codes.digest(books))).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_language_model": op6_language_model,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_url_filter": op10_url_filter,
    "op11_phrases": op11_phrases,
    "op12_vector_codes": op12_vector_codes,
    "op13_html_text": op13_html_text,
}

ORACLES: dict[str, str] = {"op9_chat_formatting": oracles.OP9, "op10_url_filter": oracles.OP10,
                           "op11_phrases": oracles.OP11, "op12_vector_codes": oracles.OP12,
                           "op13_html_text": oracles.OP13}
