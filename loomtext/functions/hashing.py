"""A family of 60-bit hashes that any engine with md5 can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(seed: int | Column, item: Column) -> Column:
    """First 15 hex digits of md5(seed|item) as bigint; null for a null item."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.md5(F.concat(seed, F.lit("|"), item)), 1, 15), 16, 10).cast("bigint")


def hash32(item: Column) -> Column:
    """First 8 hex digits of md5(item) as bigint."""
    return F.conv(F.substring(F.md5(item), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, item: Column) -> Column:
    """A number in [0, 1) from hash60."""
    return hash60(seed, item) / F.lit(float(1 << 60))
