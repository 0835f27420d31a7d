"""Sums of doubles that do not depend on the order of the rows.

A double sum rounds after every addition, so another partitioning gives other
last bits. Here every value is cut into whole numbers (its whole part and
three pieces of 24 bits below the point), those are summed exactly as longs,
and the sums are put together once at the end. Bits below 2^-72 are cut off
value by value, so the result is the same for every order, partitioning and
retry. Values of 2^31 and more, NaN and infinities are summed as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BITS, PIECES = 24, 3
LARGE = float(1 << 31)


def _trunc(x: Column) -> Column:
    return x.cast("bigint")  # towards zero


def exact_sum(value: Column | str) -> Column:
    """Like `sum` of a double column; NULL if all values are NULL."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    small = F.abs(x) < LARGE  # false for NaN (greater than all numbers) and infinities
    rest = F.when(small, x)
    parts = []
    for i in range(PIECES + 1):
        # scaling by a power of two and taking the whole part away are exact
        scaled = rest if i == 0 else rest * float(1 << PIECE_BITS)
        parts.append(F.coalesce(F.sum(_trunc(scaled)), F.lit(0)).cast("double") / float(1 << PIECE_BITS * i))
        rest = scaled - _trunc(scaled).cast("double")
    total = parts[-1]
    for p in reversed(parts[:-1]):  # small ones first
        total = p + total
    large = F.sum(F.when(~small, x))
    return F.when(F.count(x) > 0, F.when(large.isNull(), total).otherwise(total + large))
