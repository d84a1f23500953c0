"""Random draws as functions of their keys: the same under any partitioning, and in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys: Column | str | int) -> Column:
    """A whole number from 0 to 2**52 - 1 for these keys."""
    cols = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("long")


def below(m: Column, *keys: Column | str | int) -> Column:
    """A draw from 0 to m - 1; null where m is not positive."""
    return F.when(m > 0, F.pmod(draw(*keys), m))
