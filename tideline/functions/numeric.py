"""Numbers as metric queries treat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """Division of doubles where x/0 is infinite and 0/0 is not a number (null stays null)."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def hash_bucket(key: Column, salt: str, buckets: int = 100) -> Column:
    """A bucket from 0 to ``buckets`` - 1 that any engine with md5 reproduces."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")
