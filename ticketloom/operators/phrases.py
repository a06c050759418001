"""Term frequencies, TF-IDF key phrases and LDA topics of cleaned texts.

Arrays are flattened with the outer generators: before an inner one Catalyst puts a filter on the
array's size, which would compute the array a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.counts import row_count
from ticketloom.session import materialise


def term_frequencies(df: DataFrame, col: str = "cleaned_text", n: int = 100) -> DataFrame:
    """The ``n`` most frequent words."""
    words = df.select(F.explode_outer(F.split(col, " ")).alias("term")).filter("term <> ''")
    counts = words.groupBy("term").agg(row_count().alias("term_count"))
    return counts.orderBy(F.col("term_count").desc(), "term").limit(n)


def unigrams_and_bigrams(df: DataFrame, col: str) -> DataFrame:
    """Per row, in ``grams``: words of two characters or more, and pairs of neighbours among them."""
    words = df.select(F.filter(F.split(F.coalesce(col, F.lit("")), " "), lambda t: F.length(t) >= 2).alias("_words"))
    pairs = F.greatest(F.size("_words") - 1, F.lit(0))
    left, right = F.slice("_words", 1, pairs), F.slice("_words", 2, pairs)
    bigrams = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
    return words.select(F.concat("_words", bigrams).alias("grams"))


def key_phrases(df: DataFrame, col: str = "cleaned_text", vocab: int = 100, n: int = 20) -> DataFrame:
    """Top ``n`` of the ``vocab`` most frequent 1- and 2-grams by summed, row-normalised TF-IDF.

    The texts are stored once and read twice. The first pass counts terms, the rows they occur in,
    and the rows, by an empty term in each. The vocabulary, bounded by ``vocab``, returns to the rows
    as a scalar subquery, so weights and norms are computed inside each row and only partial sums per
    term move.
    """
    grams = unigrams_and_bigrams(materialise(df.select(col), "phrase-texts"), col)
    # within a row, a term that differs from the one before it in sorted order is a new one
    ordered = grams.select(F.sort_array(F.concat("grams", F.array(F.lit("")))).alias("_sorted"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_sorted"))
    occurrences = F.zip_with("_sorted", F.slice(before, 1, F.size("_sorted")), lambda term, last: F.struct(
        term.alias("term"), (~term.eqNullSafe(last)).cast("int").alias("new"),
    ))
    counts = (
        ordered.select(F.inline_outer(occurrences))
        .filter("term IS NOT NULL")
        .groupBy("term")
        .agg(row_count().alias("tf"), F.sum("new").alias("df"))
    )
    # the empty term is in every row: it counts them, and is not a term
    whole = F.struct((F.col("term") != "").alias("is_term"), "term", "df")
    top = counts.orderBy((F.col("term") == "").desc(), F.col("tf").desc(), "term").limit(vocab + 1)
    listed = top.agg(F.collect_list(whole).alias("_all")).select(
        F.filter("_all", lambda x: x["is_term"]).alias("_terms"),
        F.get(F.filter("_all", lambda x: ~x["is_term"]), F.lit(0))["df"].alias("_rows"),
    )
    idf = lambda x: F.log((F.col("_rows") + 1) / (x["df"] + 1)) + 1
    weights = listed.select(F.map_from_entries(
        F.transform("_terms", lambda x: F.struct(x["term"], idf(x)))
    ))
    rows = grams.withColumn("_idf", weights.scalar()).withColumn(
        "_hits", F.array_intersect(F.map_keys("_idf"), "grams")
    )
    frequency = lambda t: F.size("grams") - F.size(F.array_remove("grams", t))
    scored = rows.select(
        F.transform("_hits", lambda t: F.struct(
            t.alias("term"), (frequency(t) * F.element_at("_idf", t)).alias("w")
        )).alias("_terms")
    )
    norm = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    flat = scored.withColumn("_norm", norm).select("_norm", F.inline_outer("_terms"))
    flat = flat.filter("term IS NOT NULL")
    totals = flat.groupBy("term").agg(F.sum(F.col("w") / F.col("_norm")).alias("importance"))
    return totals.orderBy(F.round("importance", 9).desc(), "term").limit(n)


def topic_tokens(df: DataFrame, col: str) -> DataFrame:
    """The words of two characters or more of every text."""
    return df.select(F.filter(F.split(F.coalesce(col, F.lit("")), " "), lambda t: F.length(t) >= 2).alias("_tokens"))


def topic_vocabulary(df: DataFrame, col: str = "cleaned_text", vocab: int = 1000) -> DataFrame:
    """The ``vocab`` most frequent words with ``tf`` and smooth ``idf``; equal counts go by the word."""
    tokens = topic_tokens(df, col)
    total = tokens.agg(row_count()).scalar()
    each = tokens.select(
        F.explode_outer("_tokens").alias("term"), F.lit(1).alias("tf")
    ).filter("term IS NOT NULL").groupBy("term").agg(F.sum("tf").alias("tf"))
    rows = tokens.select(F.explode_outer(F.array_distinct("_tokens")).alias("term")).filter("term IS NOT NULL")
    held = rows.groupBy("term").agg(row_count().alias("df"))
    top = each.orderBy(F.col("tf").desc(), "term").limit(vocab)
    return top.join(held, "term").select("term", "tf", (F.log((total + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_rows(df: DataFrame, col: str, vocab: int) -> tuple[DataFrame, list[str], list[float]]:
    """Distinct texts as unit-length TF-IDF rows (``at``, ``weight``, ``n`` equal rows), with terms and idf.

    Equal texts shrink to one row before the shuffle. The vocabulary, at most ``vocab`` words, is that of
    ``topic_vocabulary`` over all rows. Rows are dealt and sorted by content.
    """
    whole = F.array_join("_tokens", " ").alias("text")
    texts = materialise(topic_tokens(df, col).select(whole).groupBy("text").agg(row_count().alias("n")), "topic-texts")
    words = texts.select(F.split("text", " ").alias("_tokens"), "n")
    total = texts.agg(F.sum("n")).scalar()
    held = lambda tokens, name: words.select(F.explode_outer(tokens).alias("term"), "n").filter("term <> ''").groupBy("term").agg(
        F.sum("n").alias(name))
    top = held("_tokens", "tf").orderBy(F.col("tf").desc(), "term").limit(vocab)
    listed = top.join(held(F.array_distinct("_tokens"), "df"), "term").select(
        "term", "tf", (F.log((total + 1) / (F.col("df") + 1)) + 1).alias("idf")
    ).orderBy(F.col("tf").desc(), "term").collect()  # at most ``vocab``
    terms, idf = [r.term for r in listed], [r.idf for r in listed]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, "text").sortWithinPartitions("text").select("text", "n")
    weigh = text_weigher(terms, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [weigh(t) for t in batch.column(0).to_pylist()]
            at, weight = (pa.array([r[i] for r in rows], pa.list_(t)) for i, t in ((0, pa.int32()), (1, pa.float64())))
            yield pa.RecordBatch.from_arrays([at, weight, batch.column(1)], names=["at", "weight", "n"])

    made = dealt.mapInArrow(run, "at array<int>, weight array<double>, n long")
    return materialise(made, "topic-rows"), terms, idf


def text_weigher(terms: list[str], idf: list[float]) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """From a text's words to the places of its known terms and their unit-length TF-IDF weights."""
    place = {t: i for i, t in enumerate(terms)}
    scale = np.array(idf)

    def weigh(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.array([place[t] for t in (text or "").split(" ") if t in place], np.int32)
        at, counts = np.unique(found, return_counts=True)
        weight = counts * scale[at] if len(at) else np.zeros(0)
        return at, weight / (np.sqrt(weight @ weight) or 1.0)

    return weigh


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the log of the gamma function, for numbers above 0."""
    shift = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        shift = np.where(low, shift - 1 / x, shift)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def document_topics(
    counts: np.ndarray, words: np.ndarray, prior: float, steps: int = 100, tolerance: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of each row of ``counts``, by variational steps, and each row's expected topics.

    ``words`` holds the exponential of every topic's expected log of its words.
    """
    weights = np.ones((len(counts), len(words)))
    expected = np.empty_like(weights)
    open_ = np.arange(len(counts))
    for _ in range(steps):
        own = weights[open_]
        theta = np.exp(digamma(own) - digamma(own.sum(axis=1))[:, None])
        share = counts[open_] / (theta @ words + 1e-100)
        made = prior + theta * (share @ words.T)
        weights[open_] = made
        open_ = open_[np.abs(made - own).mean(axis=1) >= tolerance]
        if not len(open_):
            break
    expected = np.exp(digamma(weights) - digamma(weights.sum(axis=1))[:, None])
    return weights, expected


# Rows of one dense block in a task.
TOPIC_BLOCK = 512


def fit_topics(rows: DataFrame, terms: int, k: int, seed: int, iterations: int) -> np.ndarray:
    """Batch variational Bayes of LDA: each topic's weight of every term.

    A row stands for ``n`` equal rows, so it adds its statistics ``n`` times. Tasks send the sums of
    their rows; sums of all and the topics are as large as topics times terms, whatever the corpus.
    """
    prior = 1.0 / k
    topics_ = np.random.RandomState(seed).gamma(100.0, 0.01, (k, terms))
    schema = "topic int, term int, total double"
    for _ in range(iterations):
        words = np.exp(digamma(topics_) - digamma(topics_.sum(axis=1))[:, None])

        def run(batches: Iterator[pa.RecordBatch], words: np.ndarray = words) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, terms))
            for batch in batches:
                for start in range(0, batch.num_rows, TOPIC_BLOCK):
                    part = batch.slice(start, TOPIC_BLOCK)
                    sizes = np.diff(part.column(0).offsets.to_numpy())
                    counts = np.zeros((part.num_rows, terms))
                    places = np.repeat(np.arange(part.num_rows), sizes), part.column(0).flatten().to_numpy()
                    counts[places] = part.column(1).flatten().to_numpy()
                    _, expected = document_topics(counts, words, prior)
                    share = counts * part.column(2).to_numpy()[:, None] / (expected @ words + 1e-100)
                    sums += expected.T @ share
            topic, term = np.divmod(np.arange(k * terms, dtype=np.int32), np.int32(terms))
            yield pa.RecordBatch.from_arrays(
                [pa.array(topic), pa.array(term), pa.array((sums * words).ravel())], names=["topic", "term", "total"]
            )

        totals = rows.mapInArrow(run, schema).groupBy("topic", "term").agg(F.sum("total").alias("total"))
        topics_ = np.full((k, terms), prior)
        for topic, term, total in totals.collect():  # topics times terms
            topics_[topic, term] += total
    return topics_


def topics(
    df: DataFrame, col: str = "cleaned_text", k: int = 5, words: int = 9, seed: int = 42,
    vocab: int = 1000, iterations: int = 10,
) -> DataFrame:
    """LDA topics over TF-IDF rows of the ``vocab`` most frequent words; ``words`` words each.

    Each distinct text is one row that counts as often as it occurs, so a text that many rows repeat is
    no hot key; the topics are those of the repeated rows and do not depend on how the input was cut.
    """
    session = df.sparkSession
    rows, terms, _ = tfidf_rows(df, col, vocab)
    if not terms:
        return session.createDataFrame([], "topic string, words array<string>")
    fitted = fit_topics(rows, len(terms), k, seed, iterations)
    shares = np.round(fitted / fitted.sum(axis=1)[:, None], 9)
    named = [
        (f"Topic {i + 1}", [terms[t] for t in sorted(range(len(terms)), key=lambda t: (-own[t], terms[t]))[:words]])
        for i, own in enumerate(shares)
    ]
    return session.createDataFrame(named, "topic string, words array<string>")
