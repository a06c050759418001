"""Lemma text, lexicon sentiment and its summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom.functions import text as X
from ticketloom.functions.counts import row_count
from ticketloom.functions.dates import month_end
from ticketloom.operators.lookup import INLINE_ROWS, bounded_rows, unique


# Up to this many entries a table is searched from front to back for every token.
LINEAR_ROWS = 200
# Scores are rounded so that the order of a sum cannot move one across a bucket's edge.
SCORE_DIGITS = 12


def _literal_map(rows: list, value_type: str) -> Column:
    pairs = [F.lit(x) for row in rows for x in row]
    return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{value_type}>")


def _by_text(df: DataFrame, text: Column, results: Callable[[DataFrame], DataFrame], out: str, missing: Column) -> DataFrame:
    """``out`` for every row, worked out once for each distinct text and joined back by its hash.

    ``results`` gets (``_text_key``, ``_text``) and returns (``_text_key``, ``out``). Texts are told
    apart by a 160-bit hash, so a caller's key may be null or repeat, and no text travels as a key.
    """
    keyed = df.withColumn("_text_key", F.sha1(F.coalesce(text, F.lit(""))))
    texts = keyed.select("_text_key", F.coalesce(text, F.lit("")).alias("_text")).dropDuplicates(["_text_key"])
    joined = keyed.join(results(texts), "_text_key", "left")
    return joined.select(*[F.col(c) for c in df.columns if c != out], F.coalesce(out, missing).alias(out))


def clean_lemmas(
    df: DataFrame, col: str, stopwords: DataFrame, lemmas: DataFrame, out: str = "cleaned_text",
    inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Add the space-joined lemmas of the text's tokens, stop words dropped, order and repeats kept.

    Lists of at most ``inline_rows`` entries (lemmas: ``LINEAR_ROWS``, if that is less) are looked up inside
    the row, without a shuffle. Larger ones are joined token by token, with the same result.
    """
    stopwords, lemmas = unique(stopwords, "token"), unique(lemmas, "token", "lemma")
    stop, lemma = bounded_rows(stopwords, inline_rows), bounded_rows(lemmas, min(LINEAR_ROWS, inline_rows))
    if stop is None or lemma is None:
        return _clean_lemmas_by_join(df, col, stopwords, lemmas, out)
    tokens = X.letter_tokens(F.col(col))
    remover = StopWordsRemover(
        inputCol="_tokens", outputCol="_kept", stopWords=[r.token for r in stop], caseSensitive=True
    )
    kept = remover.transform(df.withColumn("_tokens", tokens))
    known = F.array(*[F.lit(r.token) for r in lemma]).cast("array<string>")
    mapped = F.transform(
        "_kept",
        lambda t: F.when(
            F.array_contains(known, t), F.element_at(_literal_map(lemma, "string"), t)
        ).otherwise(t),
    )
    return kept.withColumn(out, F.array_join(mapped, " ")).drop("_tokens", "_kept")


def _clean_lemmas_by_join(df, col, stopwords, lemmas, out) -> DataFrame:
    def results(texts: DataFrame) -> DataFrame:
        words = texts.select("_text_key", F.posexplode_outer(X.letter_tokens(F.col("_text"))).alias("_pos", "token"))
        kept = words.filter("token IS NOT NULL").join(stopwords, "token", "left_anti")
        named = kept.join(lemmas, "token", "left")
        pairs = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "token").alias("w"))))
        return named.groupBy("_text_key").agg(F.array_join(F.transform(pairs, lambda p: p["w"]), " ").alias(out))

    return _by_text(df, F.col(col), results, out, F.lit(""))


def score_sentiment(
    df: DataFrame, col: str, lexicon: DataFrame, out: str = "sentiment_score", inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Add the mean polarity of the tokens found in the lexicon, 0 if none is.

    A lexicon of more than ``inline_rows`` words is joined on the tokens of distinct texts.
    """
    lexicon = unique(lexicon, "token", "polarity")
    words = bounded_rows(lexicon, inline_rows)
    if words is None:
        def results(texts: DataFrame) -> DataFrame:
            parts = texts.select("_text_key", F.explode_outer(F.split("_text", " ")).alias("token"))
            scored = parts.join(lexicon, "token").groupBy("_text_key")
            return scored.agg(F.round(F.avg("polarity"), SCORE_DIGITS).alias(out))

        return _by_text(df, F.col(col), results, out, F.lit(0.0))
    tokens = F.split(F.coalesce(F.col(col), F.lit("")), " ")
    known = F.array(*[F.lit(r.token) for r in words]).cast("array<string>")
    df = df.withColumn("_tokens", tokens).withColumn("_hits", F.array_intersect(known, "_tokens"))
    polarity = _literal_map(words, "double")
    times = lambda t: F.size("_tokens") - F.size(F.array_remove("_tokens", t))
    total = F.aggregate("_hits", F.lit(0.0), lambda acc, t: acc + times(t) * F.element_at(polarity, t))
    count = F.aggregate("_hits", F.lit(0), lambda acc, t: acc + times(t))
    score = F.when(F.size("_hits") > 0, F.round(total / count, SCORE_DIGITS)).otherwise(F.lit(0.0))
    return df.withColumn(out, score).drop("_tokens", "_hits")


def analyse_feedback(
    predictions: DataFrame, stopwords: DataFrame, lemmas: DataFrame, lexicon: DataFrame
) -> DataFrame:
    """Non-bug reviews with lemma text, sentiment score and sentiment bucket."""
    feedback = predictions.filter("is_bug_report = 0")
    lemma_text = clean_lemmas(feedback, "review_description", stopwords, lemmas)
    scored = score_sentiment(lemma_text, "cleaned_text", lexicon)
    return scored.withColumn("sentiment_category", X.sentiment_bucket(F.col("sentiment_score")))


def monthly_sentiment(df: DataFrame) -> DataFrame:
    """Mean score and review count of every month from the first to the last, empty ones included."""
    months = (
        df.filter("review_date IS NOT NULL")
        .groupBy(month_end(F.col("review_date")).alias("month_end"))
        .agg(F.avg("sentiment_score").alias("mean_sentiment"), row_count().alias("review_count"))
    )
    # as many entries as there are months, so one row holds them and no second pass is needed
    cells = F.collect_list(F.struct("month_end", F.struct("mean_sentiment", "review_count")))
    first = F.trunc(F.min("month_end"), "MONTH")
    calendar = months.agg(
        F.map_from_entries(cells).alias("_cells"),
        F.sequence(first, F.max("month_end"), F.expr("interval 1 month")).alias("_starts"),
    )
    spine = calendar.select("_cells", F.explode("_starts").alias("_start"))
    cell = F.element_at("_cells", F.last_day("_start"))
    return spine.select(
        F.last_day("_start").alias("month_end"),
        cell["mean_sentiment"].alias("mean_sentiment"),
        F.coalesce(cell["review_count"], F.lit(0)).alias("review_count"),
    )


def version_sentiment(df: DataFrame) -> DataFrame:
    return df.filter("app_version IS NOT NULL").groupBy("app_version").agg(
        F.avg("sentiment_score").alias("sentiment_mean"),
        F.avg("rating").alias("rating_mean"),
        F.count("review_description").alias("review_count"),
    )


def sentiment_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        row_count().alias("total_reviews"),
        F.avg("sentiment_score").alias("average_sentiment"),
        F.avg("rating").alias("average_rating"),
    )


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Reviews in each bucket, empty buckets included."""
    counts = df.agg(
        *[F.count_if(F.col("sentiment_category") == b).alias(b) for b in V.SENTIMENT_LABELS]
    )
    return counts.unpivot([], V.SENTIMENT_LABELS, "sentiment_category", "review_count")


def rating_distribution(df: DataFrame) -> DataFrame:
    return df.filter("rating IS NOT NULL").groupBy("rating").agg(row_count().alias("review_count"))
