"""Bounded draws by hash that hold at any table size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws lie below this.
RANGE = 1 << 62


def draw(*columns: Column | str) -> Column:
    """A hash of the columns from 0 to RANGE."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def share(limit: int, n: int) -> int:
    """Rows whose draw is below this are about ``limit`` of ``n``, all of them up to the limit; never none."""
    return RANGE if n <= limit else max(1, RANGE * limit // n)
