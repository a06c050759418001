"""Review feed: normalise, check, profile, upsert, impute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom.functions.dates import to_double


def normalize_feed(
    raw: DataFrame, lang: str = "en", country: str = "us", source: str = V.FEED_SOURCE
) -> DataFrame:
    """Raw store feed to ``reviews``: drop, rename, add the constant columns."""
    named = raw.drop(*V.FEED_DROPPED).withColumnsRenamed(V.FEED_RENAMES)
    rest = [c for c in named.columns if c != "review_id"]
    return named.select(
        F.lit(source).alias("source"),
        "review_id",
        F.lit(None).cast("string").alias("review_title"),
        *rest,
        F.lit(lang).alias("language_code"),
        F.lit(country).alias("country_code"),
    )


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail before any job starts if a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def available_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Those of the columns that exist, in the order asked for."""
    return df.select(*[c for c in cols if c in df.columns])


def profile_nulls(df: DataFrame) -> DataFrame:
    """Row count and null count of each column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return counts.unpivot(["_rows"], df.columns, "column_name", "null_count").select(
        "column_name", "null_count", F.col("_rows").alias("row_count")
    )


def upsert_latest(
    existing: DataFrame, incoming: DataFrame, key: str = "review_id", tiebreak: list[str] | None = None,
    incoming_wins: bool = True,
) -> DataFrame:
    """One row per key: the latest date, an undated row before all, incoming before existing.

    Rows equal in these go by ``tiebreak``, or else by all other columns. Without ``incoming_wins``
    only date and tie-break count, so the result does not depend on what came first.

    Null keys form one group. The rank filter is pushed below the shuffle as a partial group
    limit, so a hot key sends one row per input partition.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    ties = tiebreak or sorted(c for c in both.columns if c not in ("_batch", key, "review_date"))
    order = [F.col("review_date").desc_nulls_first(), *([F.col("_batch").desc()] if incoming_wins else [])]
    latest = W.partitionBy(key).orderBy(*order, *[F.col(c).asc_nulls_last() for c in ties])
    ranked = both.withColumn("_rank", F.row_number().over(latest))
    return ranked.filter("_rank = 1").drop("_rank", "_batch")


# Ranges of values among which the middle one is looked for.
RANGES = 256


def median_of(df: DataFrame, value: Column) -> Column:
    """Exact median as a scalar subquery, by distributed selection.

    Equal values are counted first. Cuts from a bounded sketch deal the distinct values into ranges, and
    one count a range tells which one or two of them hold the middle. Only their values meet in one place;
    the rows below and above stand there as one weighted value each, so the median of these few is that of
    all. Where the cuts lie is of no matter to the result. Null without values.
    """
    counts = df.select(value.cast("double").alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = counts.agg(F.array_distinct(F.percentile_approx("v", steps, 20 * RANGES))).scalar()
    range_of = lambda at: F.size(F.filter(at, lambda c: c < F.col("v")))
    dealt = counts.withColumn("_cuts", cuts).withColumn("_range", range_of(F.col("_cuts")))
    sums = dealt.groupBy("_cuts", "_range").agg(F.sum("n").alias("n"))
    known = sums.agg(
        F.first("_cuts").alias("cuts"), F.collect_list(F.struct("_range", "n")).alias("_ranges"), F.sum("n").alias("_rows"),
    )
    below = lambda x: F.aggregate(
        F.filter("_ranges", lambda y: y["_range"] < x["_range"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]
    )
    placed = F.transform("_ranges", lambda x: F.struct(x["_range"].alias("at"), below(x).alias("before"), (below(x) + x["n"]).alias("upto")))
    low, high = F.floor((F.col("_rows") + 1) / 2), F.floor(F.col("_rows") / 2) + 1
    middle = known.withColumn("_middle", F.filter(placed, lambda x: (x["upto"] >= low) & (x["before"] < high))).select(F.struct(
        "cuts", F.array_min("_middle.at").alias("first"), F.array_max("_middle.at").alias("last"),
        F.array_min("_middle.before").alias("before"), (F.col("_rows") - F.array_max("_middle.upto")).alias("after"),
    )).scalar()
    inside = counts.withColumn("_m", middle).filter(range_of(F.col("_m.cuts")).between(F.col("_m.first"), F.col("_m.last")))
    ends = df.sparkSession.range(1).withColumn("_m", middle).select(F.inline(F.array(
        F.struct(F.lit(float("-inf")).alias("v"), F.col("_m.before").alias("n")),
        F.struct(F.lit(float("inf")).alias("v"), F.col("_m.after").alias("n")),
    ))).filter("n > 0")
    return inside.select("v", "n").unionByName(ends).agg(F.percentile("v", 0.5, F.col("n"))).scalar()


def impute_rating(df: DataFrame, col: str = "rating") -> DataFrame:
    """Ratings as numbers; missing and bad ones take the median."""
    rating = to_double(F.col(col))
    return df.withColumn(col, F.coalesce(rating, median_of(df, rating)))
