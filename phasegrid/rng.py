"""A counter-based random number for each (seed, iteration, row, draw): the same on any partitioning and any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(text: Column) -> Column:
    """The first eight hex digits of the MD5 of a string, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) from the parts' values."""
    each = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return hash32(F.concat_ws(":", *[p.cast("string") for p in each])) / F.lit(4294967296.0)
