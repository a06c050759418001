"""One query per operator, over the derived review tables. Doubles are rounded for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as T
from ticketloom import fixed_values as V
from ticketloom import schemas as S
from ticketloom.functions import dates as D
from ticketloom.functions import text as X
from ticketloom.operators import (
    aggregates, ingest, language, latent, models, phrases, rollup, sentiment, state, taxonomy, tickets,
)
from ticketloom.operators.lookup import (
    lemma_table, lexicon_table, severity_table, small_table, stopword_table, taxonomy_rules,
)
from ticketloom.plans import daily
from ticketloom.session import materialise, shared_dir
from ticketloom.sources import readers, versions, writers
from ticketloom.streaming import jobs

# The selections of the filter queries.
LEVELS = ["crit", "warning"]
VERSIONS = ["1.0.0", "1.1.1", "1.2.2", "1.3.3", "1.0.4", "1.1.5"]
CATEGORIES = ["Login Error", "Payment Issue", "General Error"]
FIRST_DAY, LAST_MOMENT = "2024-01-08 00:00:00", "2024-01-21 23:59:59"
MARKED_AT = "2024-03-01 12:00:00"
# About so much text goes into a CSV file: more than a block, and not more for a task if there is more to write.
CSV_FILE_BYTES = 400_000_000

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def plain(df: DataFrame, **casts: str) -> DataFrame:
    """Dates as text and nullable counts as doubles, so that both engines hand out equal values."""
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in casts.items()})


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def categorized_once(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The categorised bugs with these columns, stored: to look for keywords again costs more than all that follows."""
    return materialise(T.categorized(spark, sf).select(*cols, "bug_category"), "categorized")


# --- sources and sinks -------------------------------------------------------------------------

@query
def feed_normalize(spark, sf):
    return ingest.normalize_feed(T.raw_feed(spark, sf))


@query
def profile_nulls(spark, sf):
    return ingest.profile_nulls(T.reviews(spark, sf))


@query
def syslog_lines(spark, sf):
    return tickets.syslog_lines(T.ticket_view(spark, sf))


@query
def summary_export(spark, sf):
    return rollup.export_summary(T.summaries(spark, sf), "Login Error")


@query
def csv_round_trip(spark, sf):
    path = shared_dir(spark, "bugs") + ".csv"
    rows = T.categorized(spark, sf).select(*S.CATEGORIZED_BUGS.names)
    writers.write_csv(rows, path)
    return readers.read_source(spark, path, "no_such_table", S.CATEGORIZED_BUGS)


@query
def table_round_trip(spark, sf):
    """A table replaced by a second write, found when no file is there."""
    name, rows = "check_" + uuid.uuid4().hex[:12], T.predictions(spark, sf).select("review_id", "rating", "review_date")
    writers.write_table(rows.limit(5), name)
    writers.write_table(rows, name)
    found = readers.read_source(spark, shared_dir(spark, "nothing"), name)
    kept = materialise(found if readers.table_exists(spark, name) else found.limit(0), "table")
    spark.sql(f"DROP TABLE {name}")
    return kept


@query
def file_before_table(spark, sf):
    path = shared_dir(spark, "sent")
    writers.replace_unless_empty(T.sent(spark, sf), path)
    replaced = writers.replace_unless_empty(T.sent(spark, sf).limit(0), path)
    return readers.read_sent(spark, path, "no_such_table").withColumn("replaced", F.lit(int(replaced)))


@query
def required_columns(spark, sf):
    """Columns that are there, in the order asked for, of a feed whose required columns were checked."""
    feed = ingest.require_columns(T.reviews(spark, sf), ["review_id", "review_description"])
    return ingest.available_columns(feed, ["rating", "no_such_column", "review_id"])


@query
def parse_dates_strict(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    written = F.when(F.col("event_type") == "click", day).when(
        F.col("event_type") == "error", F.concat(day, F.lit(" at noon"))
    ).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return T.table(spark, sf, "events").filter("event_type <> 'error'").select(
        "event_id", D.parse_ts(written, strict=True).alias("parsed")
    )


# --- projections -------------------------------------------------------------------------------

@query
def text_clean_spaced(spark, sf):
    return T.table(spark, sf, "documents").select(
        "doc_id", X.clean_spaced(F.col("text")).alias("cleaned")
    )


@query
def text_clean_words(spark, sf):
    return T.reviews(spark, sf).select(
        "review_id",
        X.clean_words(F.col("review_description")).alias("cleaned"),
        X.clean_words(F.col("review_description"), compat=True).alias("cleaned_compat"),
    )


@query
def text_clean_stripped(spark, sf):
    return T.table(spark, sf, "documents").select(
        "doc_id", X.clean_stripped(F.col("text")).alias("cleaned")
    )


@query
def text_clean_lemmas(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    return sentiment.clean_lemmas(docs, "text", stopword_table(spark), lemma_table(spark)).drop("text")


@query
def text_lengths(spark, sf):
    chars, words = X.text_lengths(F.col("cleaned"))
    return T.reviews(spark, sf).select(
        "review_id", X.clean_spaced(F.col("review_description")).alias("cleaned")
    ).select("review_id", chars.alias("review_length"), words.alias("word_count"))


@query
def bug_keyword_count(spark, sf):
    clean = X.clean_spaced(F.col("review_description"))
    return T.reviews(spark, sf).select("review_id", clean.alias("c")).select(
        "review_id", X.keyword_count(F.col("c")).alias("bug_keyword_count")
    )


@query
def categorize(spark, sf):
    return taxonomy.categorize(
        T.reviews(spark, sf), "review_description", taxonomy_rules(spark)
    ).select("review_id", "bug_category")


@query
def categorize_large(spark, sf):
    """The default taxonomy and the last three words of every document, joined whatever their number."""
    return taxonomy.categorize(
        T.reviews(spark, sf), "review_description", T.padded_rules(spark, sf), inline_rows=0
    ).select("review_id", "bug_category")


@query
def severity_map(spark, sf):
    return taxonomy.with_severity(
        T.categorized(spark, sf).select("review_id", "bug_category"), severity_table(spark)
    )


@query
def ticket_id(spark, sf):
    return tickets.with_ticket_id(T.categorized(spark, sf)).select("review_id", "ticket_key", "TicketID")


@query
def parse_dates(spark, sf):
    ts = F.col("ts").cast("string")
    written = (
        F.when(F.col("event_type") == "click", F.substring(ts, 1, 10))
        .when(F.col("event_type") == "view", F.concat(F.substring(ts, 1, 10), F.lit("T"), F.substring(ts, 12, 8)))
        .when(F.col("event_type") == "error", F.concat(F.lit("on "), ts))
        .when(F.col("event_type") == "purchase", None)
        .otherwise(F.substring(ts, 1, 19))
    )
    return T.table(spark, sf, "events").select("event_id", D.parse_ts(written).alias("parsed"))


@query
def rating_impute(spark, sf):
    written = F.when(F.col("developer_response").isNotNull(), "n/a").otherwise(F.col("rating").cast("string"))
    feed = T.reviews(spark, sf).select("review_id", written.alias("rating"))
    return rounded(ingest.impute_rating(feed), "rating")


@query
def priority_order(spark, sf):
    ordered = rollup.order_by_priority(T.summaries(spark, sf))
    return plain(
        ordered.select("bug_category", "priority_level", "priority_rank"), priority_rank="double"
    )


@query
def tickets_(spark, sf):
    return tickets.newest_first(T.ticket_view(spark, sf))


@query
def sentiment_bucket(spark, sf):
    return rounded(
        T.analysed(spark, sf).select("review_id", "sentiment_score", "sentiment_category"),
        "sentiment_score",
    )


@query
def report_text(spark, sf):
    return T.responses(spark, sf).select(
        "conv_id", "turn", X.report_text(F.col("response")).alias("report")
    )


@query
def report_bullets(spark, sf):
    return rollup.report_bullets(T.responses(spark, sf), "response")


@query
def report_sections(spark, sf):
    return rollup.parse_sections(T.responses(spark, sf))


@query
def singlish_flag(spark, sf):
    return T.reviews(spark, sf).select(
        "review_id", X.romanised_flag(F.col("review_description")).cast("int").alias("is_singlish")
    )


def _tagged(spark, sf):
    return language.language_tag(T.reviews(spark, sf), "review_description", "language_code")


@query
def language_tag(spark, sf):
    return _tagged(spark, sf).select("review_id", "detected_language")


@query
def translation_route(spark, sf):
    supplied = T.reviews(spark, sf).filter("thumbs_up > 2").select(
        "review_id", F.concat(F.lit("translated for "), F.col("user_name")).alias("translated")
    )
    routed = language.translation_route(_tagged(spark, sf), "review_description", supplied)
    return routed.select(
        "review_id", F.col("is_singlish").cast("int").alias("is_singlish"), "route", "src_lang",
        "translated_review",
    )


@query
def text_clean_lemmas_large(spark, sf):
    """Lists joined token by token, whatever their length."""
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    return sentiment.clean_lemmas(docs, "text", stopword_table(spark), lemma_table(spark), inline_rows=0).drop("text")


@query
def sentiment_score_large(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", X.clean_spaced(F.col("text")).alias("c"))
    scored = sentiment.score_sentiment(docs, "c", lexicon_table(spark), inline_rows=0)
    return rounded(scored.drop("c"), "sentiment_score")


@query
def sentiment_score(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", X.clean_spaced(F.col("text")).alias("c"))
    return rounded(
        sentiment.score_sentiment(docs, "c", lexicon_table(spark)).drop("c"), "sentiment_score"
    )


@query
def versions_sorted(spark, sf):
    return aggregates.versions_sorted(T.reviews(spark, sf))


@query
def summary_context(spark, sf):
    return rollup.summary_context(T.categorized(spark, sf))


@query
def summary_prompt(spark, sf):
    context = rollup.summary_context(T.categorized(spark, sf), numbered=False)
    return rollup.summary_prompt(context).select("bug_category", "prompt")


@query
def text_features(spark, sf):
    """Words counted by the vectors' first two stages, and the vectors' length."""
    clean = T.predictions(spark, sf).select("review_id", "review_description")
    model = models.fit_text_features(clean, "review_description")
    counted = model.stages[1].transform(model.stages[0].transform(clean)).select("review_id", "_tf")
    made = models.text_features(clean, "review_description", model=model)
    both = counted.join(made.select("review_id", "features"), "review_id")
    add = lambda power: lambda acc, x: acc + F.pow(x, F.lit(power))
    return rounded(both.select(
        "review_id",
        F.aggregate(F.unwrap_udt("_tf")["values"], F.lit(0.0), add(1)).cast("int").alias("tokens"),
        F.sqrt(F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), add(2))).alias("norm"),
    ), "norm")


# --- filters -----------------------------------------------------------------------------------

@query
def bugs_only(spark, sf):
    return tickets.bugs_only(T.predictions(spark, sf)).select("review_id", "review_description")


@query
def feedback_only(spark, sf):
    return tickets.feedback_only(T.predictions(spark, sf)).select("review_id", "review_description")


@query
def tickets_by_level(spark, sf):
    return tickets.by_level(T.ticket_view(spark, sf), LEVELS)


@query
def bugs_filtered(spark, sf):
    return tickets.by_version_category(T.categorized(spark, sf), VERSIONS, CATEGORIES)


@query
def bugs_date_range(spark, sf):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (FIRST_DAY, LAST_MOMENT))
    return tickets.by_date(T.categorized(spark, sf), low, high).select(
        "review_id", "bug_category", "review_date"
    )


@query
def high_confidence(spark, sf):
    return rounded(
        tickets.above(T.predictions(spark, sf)).select("review_id", "bug_confidence"), "bug_confidence"
    )


@query
def other_split(spark, sf):
    labelled, other = taxonomy.split_other(categorized_once(spark, sf, "review_id"))
    return labelled.withColumn("part", F.lit("keyword")).union(other.withColumn("part", F.lit("other")))


@query
def insights_by_severity(spark, sf):
    return rollup.insights_by_severity(T.summaries(spark, sf), severity_table(spark), "err")


# --- joins and state ---------------------------------------------------------------------------

@query
def attended_report(spark, sf):
    report = state.attended_report(T.attended(spark, sf), T.ticket_view(spark, sf))
    return plain(report, severity_code="double")


@query
def new_tickets(spark, sf):
    return state.new_tickets(T.ticket_view(spark, sf), T.sent(spark, sf))


@query
def mark_attended(spark, sf):
    ids = tickets.by_level(T.ticket_view(spark, sf), ["crit", "info"])
    return state.mark_attended(T.attended(spark, sf), ids, MARKED_AT)


@query
def category_insights(spark, sf):
    found = categorized_once(spark, sf, "review_date", "app_version")
    bugs = tickets.by_version_category(found, VERSIONS, [category for category, _, _ in V.SEVERITY])
    return rollup.category_insights(T.summaries(spark, sf, found), bugs, severity_table(spark))


@query
def digest_mode(spark, sf):
    legacy = state.digest_mode(T.legacy_sent(spark, sf)).withColumn("history", F.lit("legacy"))
    mixed = state.digest_mode(T.sent(spark, sf)).withColumn("history", F.lit("sent"))
    both = legacy.unionByName(mixed)
    return both.select("history", "sent_ids", F.col("first_run").cast("int").alias("first_run"))


@query
def digest_first_run(spark, sf):
    rows, _ = state.digest(T.ticket_view(spark, sf), T.legacy_sent(spark, sf))
    return rows


@query
def sent_state_next(spark, sf):
    _, after = state.digest(T.ticket_view(spark, sf), T.sent(spark, sf))
    return after


@query
def digest_confirmed(spark, sf):
    """The sent table after a digest whose sender died, and a second one that went out and was confirmed twice."""
    path, board = shared_dir(spark, "delivery"), materialise(T.ticket_view(spark, sf), "board")
    versions.write_next(T.sent(spark, sf, board).select(*S.SENT_TICKETS.names), f"{path}/sent_tickets")
    daily.prepare_digest(spark, board, path)
    _, folder = daily.prepare_digest(spark, board, path)
    daily.confirm_digest(spark, folder, path)
    return spark.read.schema(S.SENT_TICKETS).parquet(daily.confirm_digest(spark, folder, path))


@query
def digest_delivered(spark, sf):
    """The rows that a second preparation hands out after the first was never confirmed."""
    path, board = shared_dir(spark, "delivery"), materialise(T.ticket_view(spark, sf), "board")
    versions.write_next(T.sent(spark, sf, board).select(*S.SENT_TICKETS.names), f"{path}/sent_tickets")
    daily.prepare_digest(spark, board.filter("syslog_level = 'crit'"), path)
    return daily.prepare_digest(spark, board, path)[0]


@query
def upsert_latest(spark, sf):
    keyed = T.keyed_reviews(spark, sf)
    replied = F.col("developer_response").isNotNull()
    return ingest.upsert_latest(keyed.filter(~replied), keyed.filter(replied), tiebreak=["feed_id"])


# --- aggregates --------------------------------------------------------------------------------

@query
def bugs_per_category(spark, sf):
    return aggregates.bugs_per_category(T.categorized(spark, sf))


@query
def category_share(spark, sf):
    return rounded(aggregates.category_share(T.categorized(spark, sf)), "share")


@query
def version_category_grid(spark, sf):
    return aggregates.version_category_grid(T.categorized(spark, sf))


@query
def day_category_grid(spark, sf):
    return plain(aggregates.day_category_grid(T.categorized(spark, sf)), bug_count="double")


@query
def weekly_counts(spark, sf):
    return plain(aggregates.weekly_counts(T.categorized(spark, sf)), week_end="string")


@query
def weekly_sentiment(spark, sf):
    lemma_text = sentiment.clean_lemmas(
        T.categorized(spark, sf), "review_description", stopword_table(spark), lemma_table(spark)
    )
    scored = sentiment.score_sentiment(lemma_text, "cleaned_text", lexicon_table(spark))
    weekly = aggregates.weekly_sentiment(scored)
    return plain(rounded(weekly, "mean_sentiment"), week_end="string")


@query
def monthly_sentiment(spark, sf):
    monthly = sentiment.monthly_sentiment(T.analysed(spark, sf))
    return plain(rounded(monthly, "mean_sentiment"), month_end="string")


@query
def version_sentiment(spark, sf):
    return rounded(
        sentiment.version_sentiment(T.analysed(spark, sf)), "sentiment_mean", "rating_mean"
    )


@query
def sentiment_summary(spark, sf):
    return rounded(
        sentiment.sentiment_summary(T.analysed(spark, sf)), "average_sentiment", "average_rating"
    )


@query
def sentiment_distribution(spark, sf):
    return sentiment.sentiment_distribution(T.analysed(spark, sf))


@query
def rating_distribution(spark, sf):
    return sentiment.rating_distribution(tickets.feedback_only(T.predictions(spark, sf)))


@query
def developer_rollup(spark, sf):
    return rollup.developer_rollup(T.categorized(spark, sf), severity_table(spark))


@query
def kpis(spark, sf):
    bugs = categorized_once(spark, sf, "app_version")
    chosen = tickets.by_version_category(bugs, VERSIONS, CATEGORIES)
    return aggregates.kpis(chosen, bugs, categories=CATEGORIES)


@query
def bug_rate(spark, sf):
    return rounded(aggregates.bug_rate(T.predictions(spark, sf)), "bug_percentage")


@query
def priority_counts(spark, sf):
    return aggregates.priority_counts(T.summaries(spark, sf))


@query
def date_bounds(spark, sf):
    return aggregates.date_bounds(T.categorized(spark, sf))


@query
def dimension_values(spark, sf):
    return aggregates.dimension_values(T.categorized(spark, sf), "bug_category")


@query
def term_frequencies(spark, sf):
    return phrases.term_frequencies(T.analysed(spark, sf))


@query
def category_sample(spark, sf):
    return rollup.category_sample(T.categorized(spark, sf)).select(
        "bug_category", "sample_rank", "review_id"
    )


@query
def prioritized_bugs(spark, sf):
    return rounded(tickets.prioritize(T.predictions(spark, sf)), "bug_confidence")


# --- models ------------------------------------------------------------------------------------

@query
def stratified_split(spark, sf):
    return models.stratified_split(T.table(spark, sf, "labels"), "toxic", "doc_id").select(
        "doc_id", "toxic", "is_train"
    )


@query
def stratified_folds(spark, sf):
    return models.stratified_folds(T.table(spark, sf, "labels"), "toxic", "doc_id").select(
        "doc_id", "toxic", "fold"
    )


@query
def class_weights(spark, sf):
    weighted = models.with_weights(T.table(spark, sf, "labels"), "toxic")
    return rounded(weighted.select("doc_id", "unit", "balanced"), "balanced")


@query
def pseudo_labels(spark, sf):
    return models.pseudo_labels(T.predictions(spark, sf)).select("review_id", "label")


@query
def classification_report(spark, sf):
    guesses = T.table(spark, sf, "labels").withColumn("guess", 1 - F.col("quality"))
    return rounded(
        aggregates.classification_report(guesses, "toxic", "guess"), "precision", "recall", "f1"
    )


def _fitted(spark, sf):
    rows = T.training(spark, sf)
    featurizer = models.fit_text_features(rows, "processed_review")
    train = materialise(models.text_features(rows, "processed_review", model=featurizer), "train")
    return featurizer, train, models.fit_bug_classifier(train, "doc_id")


@query
def held_out_report(spark, sf):
    rows = T.training(spark, sf)
    train = models.text_features(rows, "processed_review")
    return models.train_and_evaluate(train, "doc_id")[1]


@query
def bug_classifier(spark, sf):
    """The settings searched, how many were chosen, and the chosen one's score."""
    _, _, found = _fitted(spark, sf)
    scores = small_table(spark, found.scores, S.CLASSIFIER_SCORES)
    chosen = F.col("chosen") == 1
    return scores.select(
        "c", "class_weight", "solver", scores.agg(F.count_if(chosen)).scalar().alias("settings_chosen"),
        F.round(scores.agg(F.max(F.when(chosen, F.col("f1_mean")))).scalar(), 6).alias("best_f1"),
    )


def _pool(spark, sf, featurizer):
    prepared = models.prediction_table(T.phrase_reviews(spark, sf))
    return materialise(models.text_features(prepared, "processed_review", model=featurizer), "pool")


@query
def self_training(spark, sf):
    featurizer, train, found = _fitted(spark, sf)
    pool = _pool(spark, sf, featurizer)
    again = models.self_train(found, train, pool)
    return models.score_reviews(again.model, pool).select(
        "review_id", "is_bug_report", (F.col("bug_confidence") > 0.5).cast("int").alias("likely")
    )


@query
def bug_predictions(spark, sf):
    labelled = T.training(spark, sf).select(F.col("processed_review").alias("review"), "label")
    scored = daily.predict_bugs(T.phrase_reviews(spark, sf), labelled)[0]
    return scored.select(
        "review_id", "user_name", "review_description", "review_date", "app_version", "rating", "is_bug_report",
        (F.col("bug_confidence") > 0.5).cast("int").alias("likely"), "bug_keyword_count", "review_length",
    )


@query
def reclassified(spark, sf):
    return models.reclassify_other(T.planted_bugs(spark, sf)).select(
        "review_description", "bug_category", "review_date", "app_version", "predicted_category"
    )


@query
def other_clusters(spark, sf):
    made = materialise(models.text_features(T.grouped_texts(spark, sf), "cleaned_text"), "grouped-vectors")
    return models.cluster_other(made).groupBy("cluster").agg(
        F.min("event_id").alias("first_review"), F.count(F.lit(1)).alias("reviews"),
        F.count_distinct("cleaned_text").alias("texts"),
    ).drop("cluster")


@query
def key_phrases(spark, sf):
    return rounded(phrases.key_phrases(T.analysed(spark, sf)), "importance", places=4)


@query
def hashed_weights(spark, sf):
    """Of every review's hashed vector the number, the greatest and the sum of the weights: they hold each word's idf."""
    rows = X.clean_spaced(F.col("review_description")).alias("t")
    made = models.text_features(T.phrase_reviews(spark, sf).select("review_id", rows), "t")
    listed = F.regexp_extract(F.col("features").cast("string"), r"\[([^\[\]]*)\]\)$", 1)
    weights = F.transform(F.filter(F.split(listed, ","), lambda x: x != ""), lambda x: x.cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "review_id", F.size(weights).alias("n_weights"), F.round(F.coalesce(F.array_max(weights), F.lit(0.0)), 6).alias("greatest"),
        F.round(total, 6).alias("total"),
    )


@query
def latent_groups(spark, sf):
    """Dense vectors of the grouped texts: one for each group, of length one, as the directions span all texts."""
    rows = T.grouped_texts(spark, sf)
    model = latent.fit_latent(rows, "cleaned_text")
    made = materialise(models.text_features(rows, "cleaned_text", embedder=model.embedder()), "latent-vectors")
    vector = vector_to_array("features")
    norm = F.round(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm")
    place = F.transform(vector, lambda x: F.round(x, 4) + 0.0).alias("place")
    return made.select("event_id", "cleaned_text", norm, place).groupBy("place", "norm").agg(
        F.min("event_id").alias("first_review"), F.count(F.lit(1)).alias("reviews"), F.count_distinct("cleaned_text").alias("texts"),
    ).drop("place")


@query
def csv_blocks(spark, sf):
    """Written as few CSV files and read again by blocks. Empty texts are null: such a file does not tell them apart."""
    path = shared_dir(spark, "bugs") + ".csv"
    trimmed = F.regexp_replace("review_description", r"^[\x00-\x20]+|[\x00-\x20]+$", "")  # as the sink does
    rows = T.reviews(spark, sf).select(
        "review_id", F.nullif(trimmed, F.lit("")).alias("review_description"), "developer_response", "review_date", "app_version"
    )
    stored = materialise(rows, "csv-rows")  # a few tasks write the files; more than these make the rows
    written = F.sum(F.octet_length("review_description") + F.coalesce(F.octet_length("developer_response"), F.lit(0)))
    files = max(2, -(-(stored.agg(written).first()[0] or 0) // CSV_FILE_BYTES))
    writers.write_csv(stored.coalesce(files), path)
    return readers.read_csv_blocks(spark, path, rows.schema)


# Whole texts with the default parameters; no SQL tells their rows, the tests hold them by what must be true.

@query
def topics_whole_text(spark, sf):
    return phrases.topics(T.analysed(spark, sf)).withColumn("words", F.array_join("words", " "))


@query
def other_clusters_whole_text(spark, sf):
    """The bugs of no category, as in the chain: cleaned, vectors of the words, five clusters."""
    _, other = taxonomy.split_other(categorized_once(spark, sf, "review_id", "review_description"))
    rows = materialise(other.select("review_id", X.clean_stripped(F.col("review_description")).alias("cleaned_text")), "other-texts")
    made = materialise(models.text_features(rows, "cleaned_text"), "other-vectors")
    return models.cluster_other(made).select("review_id", "cluster")


@query
def topic_vocabulary(spark, sf):
    return rounded(phrases.topic_vocabulary(T.analysed(spark, sf)), "idf")


@query
def topics(spark, sf):
    """Topics of texts from two groups of words; the words of each sorted, the topics unnumbered."""
    return phrases.topics(T.grouped_texts(spark, sf, 2), k=2, words=3, iterations=20).select(
        F.array_join(F.array_sort("words"), " ").alias("words")
    )


# --- streaming ---------------------------------------------------------------------------------

@query
def stream_upsert(spark, sf):
    target = shared_dir(spark, "upsert")
    stream = T.keyed_reviews(spark, sf, T.event_stream(spark, sf))
    jobs.stream_upsert_deltas(stream, target, shared_dir(spark, "upsert-log"), tiebreak=["feed_id"]).awaitTermination()
    return jobs.current_reviews(spark, target, stream.schema, tiebreak=["feed_id"])


@query
def stream_new_tickets(spark, sf):
    target = shared_dir(spark, "tickets")
    stream = T.ticket_view(spark, sf, T.event_stream(spark, sf))
    jobs.stream_new_tickets(
        stream, T.sent(spark, sf), target, shared_dir(spark, "tickets-log")
    ).awaitTermination()
    schema = stream.select(*state.DIGEST_COLUMNS).schema
    return spark.read.schema(schema).parquet(target).select(*state.DIGEST_COLUMNS)


@query
def stream_weekly_counts(spark, sf):
    target = shared_dir(spark, "weekly")
    stream = T.categorized(spark, sf, T.event_stream(spark, sf))
    jobs.stream_weekly_counts(stream, target, shared_dir(spark, "weekly-log")).awaitTermination()
    return plain(jobs.current_weekly_counts(spark, target), week_end="string")
