"""Deterministic pseudo-random ranks and indices from md5, equal on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts) -> Column:
    """md5 of the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def as_int(md5: Column) -> Column:
    """First 32 bits of a digest as a non-negative long."""
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")
