"""Bounded samples of rows in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def seeded_sample(rows: DataFrame, hashed: Column, n: int, total: int, spare: int = 8) -> list:
    """The first n rows by a hash. total: how many rows there are before `rows` was filtered, at most.

    One pass over the rows whose hash is in the lowest part, wide enough to hold `spare` times n rows if none was filtered. Only where fewer than one row in `spare` is left,
    a second pass looks at all of them. Each task keeps n rows at most, one task of the cluster merges them, and n rows reach the driver. The result is the same whatever the part.
    """
    place = F.pmod(hashed, F.lit(_PARTS))
    for part in sorted({min(1.0, spare * n / max(total, 1)), 1.0}):
        # With an operator above the limit a task merges the tasks' rows, and not the driver.
        got = rows.where(place < int(part * _PARTS)).orderBy(place, hashed).limit(n).coalesce(1).collect()
        if len(got) >= n:
            break
    return got
