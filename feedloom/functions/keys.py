"""Hashes that are the same in every process, language and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def content_key(product_name: str, review_text: str) -> Column:
    """First 12 hex digits of SHA-1 over product and text: equal words on one product share it."""
    return F.substring(F.sha1(F.concat(F.col(product_name), F.lit(SEPARATOR), F.col(review_text))), 1, 12)


def stable_int(text: Column) -> Column:
    """First 8 bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def product_slug(name: Column) -> Column:
    """Lower case, everything but letters and digits to `_`, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def order_hash(column: str, seed: int) -> Column:
    """A pseudo-random but repeatable ordering of rows, the same on any partitioning."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(column).cast("string")))
