"""Global order without a single task: slices of a key's range, and row numbers built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_bounds(df: DataFrame, key: str, slices: int) -> list:
    """At most ``slices - 1`` ascending values of ``key`` that cut it into parts of like size.

    The sketch and the list are as large as ``slices`` asks for, whatever the number of rows. Any
    bounds give the same final result; only the balance depends on the sketch.
    """
    shares = [F.lit(i / slices) for i in range(1, slices)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(key, F.array(*shares), F.lit(max(10_000, 4 * slices)))).first()[0]
    return sorted(set(found or []))


def slice_of(key: str, bounds: list) -> Column:
    """The number of bounds at or below the key, by binary search; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    cuts, steps = F.array(*map(F.lit, bounds)), []
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1

    def halve(low, width):
        fits = (low + width <= len(bounds)) & (F.get(cuts, low + width - 1) <= F.col(key))
        return F.when(fits, low + width).otherwise(low)

    return F.aggregate(F.array(*steps), F.lit(0), halve)


def default_slices(df: DataFrame) -> int:
    """Eight slices for every shuffle partition, so that no partition holds much more than others."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_number(df: DataFrame, key: str, ties: list[str], name: str) -> tuple[DataFrame, int]:
    """Add ``name``: the row's place from 0 in the order of ``key`` (nulls first), then ``ties``.

    Returns the frame and the number of rows. Slices are numbered apart and start where the slices
    before end, so no task sees more than a slice. Rows equal in key and ties are interchangeable.
    """
    bounds = slice_bounds(df, key, default_slices(df))
    sliced = df.withColumn("_slice", slice_of(key, bounds))
    counts = dict(sliced.groupBy("_slice").count().collect())  # one row a slice
    starts, total = [], 0
    for i in range(len(bounds) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    within = Window.partitionBy("_slice").orderBy(F.col(key).asc_nulls_first(), *ties)
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_slice"))
    return sliced.withColumn(name, start + F.row_number().over(within) - 1).drop("_slice"), total

