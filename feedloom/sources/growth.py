"""Grow a dataset batch by batch from arriving tables: more customers, or more time.

Each step finds what is new by key or by time, writes it as one batch, and commits. Asking for what is
already there does nothing; a dataset started under other settings is refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.incremental import time_slice
from feedloom.operators.integrity import FINDERS, check_integrity
from feedloom.operators.validate import check_tables
from feedloom.schemas import TABLES, TableSpec, conform
from feedloom.sources.dataset import (
    last_batch,
    read_commits,
    read_dataset,
    read_or_none,
    settings_hash,
    write_batch,
    write_commit,
)

# the column that says when a row of a table came to be
EVENT_TIMES = {"orders": "ordered_at", "reviews": "reviewed_at"}


@dataclass(frozen=True)
class BatchReport:
    """What a step did. `batch_id` is None when there was nothing to do."""

    kind: str
    batch_id: int | None
    counts: dict[str, int]
    note: str = ""


def init_dataset(spark: SparkSession, path: str, *, as_of: datetime, settings: Mapping) -> None:
    """Start a dataset at a date. Repeating it is fine; other settings are refused."""
    wanted = settings_hash(settings)
    if read_commits(spark, path).limit(1).count():
        _same_settings(spark, path, wanted)
        return
    left_over = [name for name, spec in TABLES.items()
                 if read_or_none(spark, f"{path}/{name}.parquet", spec.schema) is not None
                 or read_or_none(spark, f"{path}/{name}", spec.schema) is not None]
    if left_over:
        raise ValueError(f"{path} holds tables but no commit list: {', '.join(left_over)}")
    write_commit(spark, path, batch_id=0, kind="init", counts={}, as_of=as_of, settings_hash=wanted)


def _same_settings(spark: SparkSession, path: str, wanted: str) -> None:
    if read_commits(spark, path).where((F.col("batch_id") == 0) & (F.col("settings_hash") == wanted)).isEmpty():
        raise ValueError(f"{path} was started with other settings; use another folder")


def current(spark: SparkSession, path: str) -> tuple[int, datetime]:
    """(last batch id, date the dataset stands at)."""
    row = read_commits(spark, path).agg(F.max("batch_id").alias("batch"), F.max("as_of").alias("as_of")).first()
    if row.batch is None:
        raise FileNotFoundError(f"no dataset at {path}: initialise it first")
    return row.batch, row.as_of


def _commit(spark: SparkSession, path: str, kind: str, tables: Mapping[str, DataFrame], as_of: datetime, wanted: str,
            specs: Mapping[str, TableSpec], rules: list[str] | None, dry_run: bool, writer: str | None = None) -> BatchReport:
    """Check the batch, write it, commit it. With `dry_run` it is checked and counted only."""
    check_batch(tables, read_dataset(spark, path, specs=specs), specs=specs, rules=rules)
    if dry_run:
        return BatchReport(kind, None, {name: df.count() for name, df in tables.items()}, "dry run: nothing is written")
    batch_id = max(0, last_batch(spark, path)) + 1
    counts = write_batch(tables, batch_id, path, specs=specs)
    write_commit(spark, path, batch_id=batch_id, kind=kind, counts=counts, as_of=as_of, settings_hash=wanted,
                 writer=writer)
    return BatchReport(kind, batch_id, counts)


def check_batch(new: Mapping[str, DataFrame], stored: Mapping[str, DataFrame], *,
                specs: Mapping[str, TableSpec] = TABLES, rules: list[str] | None = None) -> None:
    """Raise if a new table breaks its schema or value rules, or old and new rows together a rule across tables.

    `rules` names the rules across tables to hold (all, if None; none, if empty); those whose tables are absent
    are skipped. Unique columns are checked among the new rows. Runs jobs.
    """
    fresh = {name: conform(df, specs[name].ddl) for name, df in new.items()}
    check_tables(fresh, dict(specs))
    whole = dict(stored) | {name: df.unionByName(stored[name].select(df.columns)) if name in stored else df
                            for name, df in fresh.items()}
    named = [name for name, (needs, _) in FINDERS.items()
             if (rules is None or name in rules) and all(n in whole for n in needs)]
    if named:
        check_integrity(whole, rules=named)


def _of_customers(source: Mapping[str, DataFrame], people: DataFrame, since: datetime | None, until: datetime) -> dict:
    """Orders, lines, reviews and truth of `people` that happened in the slice.

    Reviews are cut by their own time, so a late review of an early purchase lands in the right batch.
    """
    ids = people.select("customer_id")
    new = {}
    for name in ("orders", "reviews"):
        if name in source:
            mine = source[name].join(ids, "customer_id", "left_semi")
            new[name] = time_slice(mine, EVENT_TIMES[name], since=since, until=until)
    if "order_lines" in source:
        new["order_lines"] = source["order_lines"].join(new["orders"].select("order_id"), "order_id", "left_semi")
    if "review_truth" in source:
        new["review_truth"] = source["review_truth"].join(new["reviews"].select("review_id"), "review_id", "left_semi")
    return new


def add_customers(spark: SparkSession, path: str, source: Mapping[str, DataFrame], *, settings: Mapping,
                  specs: Mapping[str, TableSpec] = TABLES, up_to: object = None, rules: list[str] | None = None,
                  dry_run: bool = False) -> BatchReport:
    """Add every customer of the source, or those with an id up to `up_to`, that is not stored yet, with their history."""
    wanted = settings_hash(settings)
    _same_settings(spark, path, wanted)
    _, as_of = current(spark, path)
    people = source["customers"] if up_to is None else source["customers"].where(F.col("customer_id") <= F.lit(up_to))
    stored = read_dataset(spark, path, specs=specs)
    if "customers" in stored:
        people = people.join(stored["customers"].select("customer_id"), "customer_id", "left_anti")
    if people.isEmpty():
        return BatchReport("add-customers", None, {}, "nothing to do: every customer is stored")
    new = {"customers": people, **_of_customers(source, people, None, as_of)}
    return _commit(spark, path, "add-customers", new, as_of, wanted, specs, rules, dry_run)


def advance(spark: SparkSession, path: str, source: Mapping[str, DataFrame], *, to: datetime, settings: Mapping,
            specs: Mapping[str, TableSpec] = TABLES, rules: list[str] | None = None,
            dry_run: bool = False) -> BatchReport:
    """Move the dataset to a later date: what the stored customers bought and reviewed since."""
    wanted = settings_hash(settings)
    _same_settings(spark, path, wanted)
    _, as_of = current(spark, path)
    if to <= as_of:
        return BatchReport("advance", None, {}, f"nothing to do: the dataset stands at {as_of:%Y-%m-%d}")
    stored = read_dataset(spark, path, specs=specs)
    if "customers" not in stored:
        raise ValueError("add customers before moving time")
    new = _of_customers(source, stored["customers"], as_of, to)
    return _commit(spark, path, "advance", new, to, wanted, specs, rules, dry_run)


def fill_texts(spark: SparkSession, path: str, texts: DataFrame, *, settings: Mapping, writer: str,
               specs: Mapping[str, TableSpec] = TABLES, rules: list[str] | None = None,
               dry_run: bool = False) -> BatchReport:
    """Store texts for reviews that still lack one. Texts already stored stay as they are."""
    wanted = settings_hash(settings)
    _same_settings(spark, path, wanted)
    _, as_of = current(spark, path)
    stored = read_dataset(spark, path, specs=specs)
    waiting = stored["reviews"].select("review_id")
    if "review_texts" in stored:
        waiting = waiting.join(stored["review_texts"].select("review_id"), "review_id", "left_anti")
    fresh = texts.join(waiting, "review_id", "left_semi")
    if fresh.isEmpty():
        return BatchReport("fill-texts", None, {}, "nothing to do: no waiting review has a text")
    return _commit(spark, path, "fill-texts", {"review_texts": fresh}, as_of, wanted, specs, rules, dry_run, writer)
