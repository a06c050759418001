"""Counts, shares, dense grids, calendar series and headline numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom.functions import text as X
from ticketloom.functions.counts import row_count
from ticketloom.functions.dates import week_ending
from ticketloom.operators.lookup import distinct_array


# Rows that weekly counts are about.
KEYED = "review_date IS NOT NULL AND app_version IS NOT NULL AND bug_category IS NOT NULL"


def bugs_per_category(bugs: DataFrame) -> DataFrame:
    counts = bugs.groupBy("bug_category").agg(row_count().alias("bug_count"))
    return counts.orderBy(F.col("bug_count").desc(), "bug_category")


def category_share(bugs: DataFrame) -> DataFrame:
    counts = bugs.groupBy("bug_category").agg(row_count().alias("bug_count"))
    counts = counts.filter("bug_category IS NOT NULL")
    total = counts.agg(F.sum("bug_count")).scalar()
    return counts.withColumn("share", F.col("bug_count") / total)


def _categories(cells: DataFrame):
    """The categories seen, as an array. Its filter keeps the counts in the plan, so that the
    subquery's shuffle equals that of the counts and is reused."""
    return distinct_array(cells.filter("n > 0"), "bug_category")


def version_category_grid(bugs: DataFrame) -> DataFrame:
    """Every seen version with every seen category, zero where there is no bug."""
    seen = bugs.filter("app_version IS NOT NULL AND bug_category IS NOT NULL")
    cells = seen.groupBy("app_version", "bug_category").agg(row_count().alias("n"))
    rows = cells.groupBy("app_version").agg(
        F.map_from_entries(F.collect_list(F.struct("bug_category", "n"))).alias("_n")
    )
    dense = rows.withColumn("bug_category", F.explode(_categories(cells)))
    count = F.coalesce(F.element_at("_n", F.col("bug_category")), F.lit(0))
    return dense.select("app_version", "bug_category", count.cast("bigint").alias("bug_count"))


def day_category_grid(bugs: DataFrame, zero_fill: bool = False) -> DataFrame:
    """Days 1 to 31 with every category seen on a dated bug.

    A missing pair is null on a day that has bugs and 0 on a day that has none, unless
    ``zero_fill`` asks for plain zeros.
    """
    seen = bugs.filter("review_date IS NOT NULL AND bug_category IS NOT NULL")
    dated = seen.withColumn("day_of_month", F.dayofmonth("review_date")).dropna(subset=["day_of_month"])
    by_day = dated.groupBy("day_of_month", "bug_category").agg(row_count().alias("n"))
    days = by_day.groupBy("day_of_month").agg(
        F.map_from_entries(F.collect_list(F.struct("bug_category", "n"))).alias("_n")
    )
    # at most 31 maps, each as long as the taxonomy: one row holds them all
    month = days.agg(
        F.map_from_entries(F.collect_list(F.struct("day_of_month", "_n"))).alias("_days"),
        F.array_distinct(F.flatten(F.collect_list(F.map_keys("_n")))).alias("_categories"),
    )
    all_days = F.sequence(F.lit(1), F.lit(31))
    by_number = month.select("_days", "_categories", F.explode(all_days).alias("day_of_month"))
    dense = by_number.select(
        "day_of_month",
        F.element_at("_days", F.col("day_of_month")).alias("_n"),
        F.explode("_categories").alias("bug_category"),
    )
    count = F.element_at("_n", F.col("bug_category"))
    absent = F.lit(True) if zero_fill else F.col("_n").isNull()
    return dense.select(
        "day_of_month",
        "bug_category",
        F.when(count.isNull() & absent, F.lit(0)).otherwise(count).cast("bigint").alias("bug_count"),
    )


def _weekly(bugs: DataFrame, measure) -> DataFrame:
    # plain null tests: one on a category that is never null falls away, where dropna would be
    # pushed down and find the category a second time
    keyed = bugs.filter(KEYED).withColumn("week_end", week_ending(F.col("review_date")))
    return keyed.groupBy("week_end", "app_version", "bug_category").agg(measure)


def weekly_counts(bugs: DataFrame) -> DataFrame:
    return _weekly(bugs, row_count().alias("bug_count"))


def weekly_sentiment(bugs: DataFrame, score: str = "sentiment_score") -> DataFrame:
    return _weekly(bugs, F.avg(score).alias("mean_sentiment"))


def versions_sorted(df: DataFrame) -> DataFrame:
    """Distinct trimmed versions in natural order, with their sort key."""
    version = X.strip(F.col("app_version"))
    seen = df.select(version.alias("app_version")).filter("app_version <> ''").distinct()
    return seen.withColumn("version_key", X.version_key(F.col("app_version"))).orderBy(
        "version_key", "app_version"
    )


def kpis(filtered: DataFrame, bugs: DataFrame, versions: list[str] | None = None,
         categories: list[str] | None = None) -> DataFrame:
    """Filtered bugs, selected categories and versions, latest version of all bugs.

    Without a selection every category and version of ``bugs`` counts as selected.
    """
    version = X.strip(F.col("app_version"))
    pairs = bugs.select("bug_category", F.when(version != "", version).alias("v")).distinct()
    key = F.when(F.col("v").isNotNull(), X.version_key(F.col("v")))
    overall = pairs.agg(
        F.count_distinct("bug_category").alias("categories"),
        F.count_distinct("v").alias("versions"),
        F.coalesce(F.max_by("v", key), F.lit("N/A")).alias("latest_version"),
    )
    chosen = lambda given, col: F.col(col) if given is None else F.lit(len(given)).cast("bigint")
    return overall.select(
        filtered.agg(row_count()).scalar().alias("total_bugs"),
        chosen(categories, "categories").alias("categories"),
        chosen(versions, "versions").alias("versions"),
        "latest_version",
    )


def bug_rate(predictions: DataFrame, threshold: float = V.HIGH_CONFIDENCE) -> DataFrame:
    found = F.coalesce(F.sum(F.col("is_bug_report").cast("bigint")), F.lit(0))
    return predictions.agg(
        row_count().alias("total_reviews"),
        found.alias("bug_count"),
        F.when(row_count() > 0, found * 100.0 / row_count()).otherwise(F.lit(0.0)).cast("double").alias("bug_percentage"),
        F.count_if(F.col("bug_confidence") > threshold).alias("high_confidence"),
    )


def priority_counts(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("priority_level").agg(row_count().alias("categories"))


def date_bounds(df: DataFrame, col: str = "review_date") -> DataFrame:
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def dimension_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("value")).distinct().orderBy("value")


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support by class, then accuracy, macro and weighted averages.

    The input shrinks to its confusion matrix in one partial aggregation.
    """
    cells = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        row_count().alias("n")
    )
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
            )
        ).alias("s"),
        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
    )
    per_class = sides.groupBy("s.c").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.claimed").alias("claimed"),
        (F.sum("hit") / 2).cast("bigint").alias("hits"),
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    hits, support, claimed = F.col("hits"), F.col("support"), F.col("claimed")
    lines = F.array(
        F.struct(F.col("c").cast("string").alias("class"), F.lit(1).cast("bigint").alias("weight")),
        F.struct(F.lit("macro avg").alias("class"), F.lit(1).cast("bigint").alias("weight")),
        F.struct(F.lit("weighted avg").alias("class"), support.alias("weight")),
        F.struct(F.lit("accuracy").alias("class"), support.alias("weight")),
    )
    scored = per_class.select(
        support, hits,
        ratio(hits, claimed).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, claimed + support).alias("f1"),
        F.explode(lines).alias("line"),
    )
    accuracy = F.sum("hits") / F.sum("support")

    def mean(m: str):
        average = F.sum(F.col(m) * F.col("line.weight")) / F.sum("line.weight")
        return F.when(F.col("class") == "accuracy", accuracy).otherwise(average).alias(m)

    return scored.groupBy(F.col("line.class").alias("class")).agg(
        mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support")
    )
