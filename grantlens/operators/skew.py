"""Keeping look-up joins splittable when the probing side crowds on a few keys.

Adaptive execution splits a skewed join partition only where both inputs of the join are plain
shuffles. A side that was just grouped (or ranked) by the join key is already placed by that key,
so Spark adds no shuffle for it and the join cannot be split: one hot key stays one task. Grouping
by the key plus a hash of the key gives the same groups but a placement the join cannot reuse, so
the small, already reduced side is shuffled once more and the large side may be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = "_spread"


def spread(*keys: str) -> Column:
    """Hash of the keys, to group by next to the keys themselves."""
    return F.xxhash64(*keys).alias(SPREAD)


def reduce_by(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """groupBy(keys).agg(aggregates), placed so that a join on the keys stays splittable."""
    return df.groupBy(*keys, spread(*keys)).agg(*aggregates).drop(SPREAD)


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, partly combined before the shuffle, for use as the look-up side of a join."""
    return df.select(*keys, spread(*keys)).distinct().drop(SPREAD)
