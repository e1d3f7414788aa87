"""Helpers the operators share: settings, intermediate tables, Arrow maps, word hashes, interval arithmetic."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import materialise, shared_dir, tune

#: Bounds memory of a Python worker only; results do not depend on them.
ARROW_BYTES = "4m"
CACHED_WORDS = 150_000
CACHED_WORD_BYTES = 64

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, Arrow batches bounded by bytes, and a checkpoint folder where none is named."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: nothing before it is computed again."""
    return materialise(df, name)


class Kept(dict):
    """What a function has computed; it does not travel with the function, every task fills its own."""

    def __reduce__(self):
        return type(self), ()


def once(fn: Callable) -> Callable:
    """`fn`, computed once per arguments and task. Unlike the standard caches it can be shipped by value."""
    kept = Kept()

    def call(*args):
        if args not in kept:
            kept[args] = fn(*args)
        return kept[args]

    call.forget = kept.clear
    return call


def give_back() -> None:
    """Hand memory that a worker has freed back to the system: idle workers stay alive and share it with busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """`fn` over the Arrow batches of each partition; its memory is given back at the end."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(over, schema)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit: a bounded memo, never a vocabulary."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (space and \\x09 to \\x0D)."""
    return text.lower().split()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, in order; a shorter text is one run of all its words, none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, U64(size))
    for k in range(size):
        out = mix((out ^ words[k:n - size + 1 + k]) * MULTIPLIER)
    return out


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


BITMAP_BITS = 1 << 23  # 1 MB when packed: a proven bound, whatever the number of keys


def bitmap_of(keys: DataFrame, key: str) -> np.ndarray:
    """A fixed-size membership bitmap of a 64-bit column: no key is missed, a few others pass. Runs a job.

    Keys are reduced to words of the bitmap by Spark; at most BITMAP_BITS / 64 rows of 16 bytes reach the driver.
    """
    slot = F.col(key).bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = (keys.select(F.shiftright(slot, 5).alias("w"),
                         F.expr(f"shiftleft(1L, cast({key} & 31 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    bits = np.zeros(BITMAP_BITS // 32, np.uint32)
    bits[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().astype(np.uint32)
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(U64) & U64(BITMAP_BITS - 1)
    return (bits[(slot >> U64(5)).astype(np.int64)] >> (slot & U64(31)).astype(np.uint32)) & np.uint32(1) > 0


def membership(bits: np.ndarray):
    """A filter of a long column by a bitmap; null passes."""

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(keys.isna().to_numpy() | in_bitmap(bits, keys.fillna(0).to_numpy(np.int64)))

    return maybe


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by `keys` (integer columns): tables of whole groups, and where each group starts."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        values = np.stack([table.column(k).to_numpy() for k in keys])
        starts = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1])
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def in_blocks(rows: DataFrame, keys: list[str], member: str, blocks: str) -> DataFrame:
    """`rows` grouped in partitions by `keys`; a group of several `blocks` (an int column) is cut by a hash of
    `member`, and each pair of its blocks is a group of its own, named by `keys`, block_a and block_b."""
    part, other = F.pmod(F.xxhash64(member), F.col(blocks)).cast("int"), F.col("__other")
    named = [*keys, "block_a", "block_b"]
    return (rows.withColumn("__part", part).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
            .withColumn("block_a", F.least("__part", other)).withColumn("block_b", F.greatest("__part", other))
            .drop("__part", "__other", blocks).repartition(*named).sortWithinPartitions(*named))


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals as maximal runs; touching intervals are one run."""
    out: list[list[int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
