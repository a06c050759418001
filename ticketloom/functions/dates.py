"""Calendar expressions on ``timestamp_ntz`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd"]


def parse_ts(c: Column, formats: list[str] | None = None, strict: bool = False) -> Column:
    """Text to timestamp by the first format that fits; a bad text is null, or an error if strict."""
    tries = [
        F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats or DEFAULT_FORMATS
    ]
    parsed = F.coalesce(*tries)
    if not strict:
        return parsed
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), c)).cast("timestamp_ntz")
    return F.when(c.isNull(), None).when(parsed.isNotNull(), parsed).otherwise(bad)


def to_double(c: Column) -> Column:
    """Number or null."""
    return c.try_cast("double")


def week_ending(c: Column) -> Column:
    """The Sunday that ends the week."""
    return F.date_add(F.trunc(c.cast("date"), "WEEK"), 6)


def month_end(c: Column) -> Column:
    return F.last_day(c.cast("date"))
