"""Range partitioning: boundaries from sorted sample keys, and rows dealt by them.

Spark's own range partitioner serves ORDER BY. These two are for callers that want the boundaries, to deal
several tables alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = tuple
#: Boundaries a DataFrame is dealt by: each is a comparison in every row.
MOST_BOUNDARIES = 1000


def compare(a: Key, b: Key, descending: Sequence[bool] | None = None) -> int:
    """Nulls come first in either direction."""
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        if x is None or y is None:
            return -1 if x is None else 1
        smaller = x < y
        return (1 if smaller else -1) if descending and descending[k] else (-1 if smaller else 1)
    return 0


def boundaries(keys: Sequence[Key], n: int, descending: Sequence[bool] | None = None) -> list[Key]:
    """At most n - 1 keys that cut the keys into n ranges of about equal numbers; rows from a boundary on are in the range after it.
    Equal keys stay together, so there may be fewer."""
    ordered = sorted(keys, key=cmp_to_key(lambda a, b: compare(a, b, descending)))
    share, out, filled = len(ordered) / max(1, n), [], 0
    for k, key in enumerate(ordered):
        if k and key != ordered[k - 1] and filled >= share and len(out) < n - 1:
            out.append(key)
            filled = 0
        filled += 1
    return out


def range_number(key: Key, bounds: Sequence[Key], descending: Sequence[bool] | None = None) -> int:
    """How many boundaries the key has reached."""
    return sum(compare(key, b, descending) >= 0 for b in bounds)


def range_column(columns: Sequence[str], bounds: Sequence[Key], descending: Sequence[bool] | None = None) -> Column:
    """range_number as an expression, for repartition or partitionBy."""
    if len(bounds) > MOST_BOUNDARIES:
        raise ValueError(f"at most {MOST_BOUNDARIES} boundaries")

    def reached(bound: Key) -> Column:
        result = F.lit(True)
        for k in reversed(range(len(columns))):
            c = F.col(columns[k])
            if bound[k] is None:
                after, same = c.isNotNull(), c.isNull()
            else:
                after = c.isNotNull() & ((c < bound[k]) if descending and descending[k] else (c > bound[k]))
                same = c.eqNullSafe(F.lit(bound[k]))
            result = after | (same & result)
        return F.coalesce(result, F.lit(False)).cast("int")

    total = F.lit(0)
    for b in bounds:
        total = total + reached(b)
    return total


def sample_boundaries(df: DataFrame, columns: Sequence[str], n: int, rate: float = 0.1, most: int = 100_000, seed: int = 1, descending: Sequence[bool] | None = None) -> list[Key]:
    """Boundaries from a sample of at most ``most`` rows of the whole table; it costs a count of the rows."""
    keys = df.select(*columns)
    enough = 1.1 * most / max(1, keys.count())

    def some(rate: float) -> list:
        # what is more than most goes by lot, not by its place in the table
        return keys.sample(min(1.0, rate, enough), seed).orderBy(F.rand(seed + 1)).limit(most).collect()

    return boundaries([tuple(r) for r in some(rate) or some(1.0)], n, descending)
