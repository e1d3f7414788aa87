"""From raw documents to packed training sequences, in five stages of `feedloom.llm`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontaminate, language, line_dedup, minhash, packing
from feedloom.llm.common import prepare, read, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, of which no learned language has 30 % of the letters, or unlike all of them, go."""
    prepare(spark)
    return language.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two lines and more that stand at an earlier place are cut out whole; documents left empty go."""
    prepare(spark)
    return line_dedup.without_passages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays (five-word shingles, similarity 0.8)."""
    prepare(spark)
    return minhash.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("language", languages), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("packing", sequences)]

#: Viterbi paths, passages compared byte by byte and verified signatures are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each writes Parquet to the shared folder, which the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
