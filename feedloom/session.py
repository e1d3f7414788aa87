"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split hot join keys at run time, also where that costs one more shuffle downstream
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the roll-up gathers small sets per review: keep hashing instead of sorting after 128 groups
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # the JVM leaves methods above 8,000 bytes uncompiled: steps that would become one run by their own shorter code
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # scorers receive whole reviews: bound an Arrow batch by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


TEXT_CODEC = "zstd"  # what holds text or sentences is written by it: a third smaller than by Spark's usual codec

# Before a run Spark knows a table's compressed size on disk, less the share of columns not read. A product list takes ten
# times that and more in memory, the keys of stored answers over a hundred times, once in the driver and once per executor;
# so what is only guessed must be small. What was measured by a shuffle may be as large as the cluster allows.
GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
GUESSED_BYTES = 1 << 18


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings. Partition counts and memory stay as the cluster set them; so does the size up to which a
    table is broadcast, but where Spark can only guess it: that is GUESSED_BYTES, if the cluster allows as much."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    allowed = spark.conf.get(GUESSED)
    if _bytes(allowed) > GUESSED_BYTES:
        if spark.conf.get(MEASURED, None) is None:
            spark.conf.set(MEASURED, allowed)
        spark.conf.set(GUESSED, f"{GUESSED_BYTES}b")
    return spark


@contextmanager
def kept_together(spark: SparkSession) -> Iterator[None]:
    """What runs inside joins rows where they are, if both sides are spread by some of the columns they are joined on. Not
    for all queries: sides that are spread by more columns on purpose, as slices of a busy key are, would lose that."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@lru_cache(maxsize=1)
def _local_scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="feedloom-")  # goes when the driver's Python ends


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Where it is unset, a temporary folder is made, but only for a local master: on a cluster such a
    folder would exist on one machine only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch().name


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder, below one folder per application, which may go when that has ended."""
    return f"{shared_dir(spark)}/feedloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, so what follows never recomputes it. Runs a job."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
