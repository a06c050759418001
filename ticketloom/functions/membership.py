"""Membership bits: a table's values as a bounded array of bits, asked inside the row.

``may_hold`` is false only for values that the table surely does not hold. Built by an aggregate of as
many rows as the array has words, so nothing grows with the table but the share of wrong hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two places a value; of sixteen bits a value some one in seventy is then a wrong hit.
SEEDS = (11, 23)
BITS_A_VALUE = 16
FEWEST, MOST = 10, 23  # as powers of two: 128 bytes to 1 MB


def power_for(values: int, most: int = MOST) -> int:
    """The power of two of bits for so many values, within the bounds."""
    return min(max((max(values, 1) * BITS_A_VALUE - 1).bit_length(), FEWEST), most)


def _places(value: Column, power: int) -> list[Column]:
    return [F.xxhash64(value, F.lit(seed)).bitwiseAND(F.lit((1 << power) - 1)) for seed in SEEDS]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def member_bits(values: DataFrame, col: str, power: int) -> Column:
    """The bits of all values of ``col``, as a scalar subquery of 2 ** (``power`` - 6) longs."""
    held = values.select(F.explode(F.array(*_places(F.col(col), power))).alias("_place"))
    words = held.select(F.shiftright("_place", 6).alias("word"), _bit(F.col("_place")).alias("bits"))
    blank = values.sparkSession.range(1 << (power - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    merged = blank.unionByName(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return merged.agg(F.transform(ordered, lambda x: x["bits"])).scalar()


def may_hold(bits: Column, value: Column, power: int) -> Column:
    """Could ``value`` be among those that made the bits? Never false for one that is."""
    tests = [F.get(bits, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0 for p in _places(value, power)]
    return tests[0] & tests[1]
