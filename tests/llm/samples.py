"""Small tables with everything that real ones may hold."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" + ("." if k % 9 == 8 else "") for k in range(words))


def documents(spark, texts, clash: tuple[str, ...] = ()):
    """A documents table of (doc_id, text) pairs, with further columns of the given names."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in clash:
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit("x"))
    return df


ODD_TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (None, "one two"),
             (7, "é" * 30_000), (8, "x " * 20_000), (4, "one"), (9, "日本語のテキスト"), (10, "one two three four")]
