"""Sentences, and the one row per distinct text that scoring works on.

Splitting is a map: the array of sentences is cleaned before it is exploded, so positions have no
gaps, the count is the array's size, and no shuffle is needed. Catalyst drops the review text from
the exploded rows unless a later step asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARY = "\u001f"
WHITESPACE = r"(?U)[^\S ]\s*| \s+"  # but for single spaces, which stay as they are: most of a text's white space
SENTENCE_END = "([.!?]+) |([。！？]+) ?"


def sentences_of(text: Column) -> Column:
    """Array of trimmed, non-empty sentences."""
    one_line = F.regexp_replace(text, WHITESPACE, " ")
    marked = F.regexp_replace(one_line, SENTENCE_END, f"$1$2{BOUNDARY}")
    pieces = F.transform(F.split(marked, BOUNDARY), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: F.length(s) > 0)


def split_sentences(reviews: DataFrame, *, text: str = "review_text") -> DataFrame:
    """One row per sentence with every review column, its 0-based position and the review's count."""
    # the count is taken below the explode, so the array itself is not carried into every row
    arrays = reviews.withColumn("__sentences", sentences_of(F.col(text))) \
        .withColumn("sentence_count", F.size("__sentences"))
    # the outer form plus a filter: from the plain one the optimizer derives "not empty" filters that
    # would run the whole split twice more per review
    exploded = arrays.select(*reviews.columns, "sentence_count",
                             F.posexplode_outer("__sentences").alias("sentence_index", "sentence"))
    return exploded.where(F.col("sentence").isNotNull())


def sentence_counts(reviews: DataFrame, *, id: str = "review_id", text: str = "review_text") -> DataFrame:
    """Sentences per review, without exploding."""
    return reviews.select(id, F.size(sentences_of(F.col(text))).alias("sentence_count")).where("sentence_count > 0")
