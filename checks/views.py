"""Review tables derived from the driver's parquet tables, whole.

Every event is a review. Its text is a short phrase picked by the event's ``k``, the event type,
and the whole text of the document with the same number if there is one. Some values of ``k``
plant a null text, an empty text, a null date or a null rating.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators import ingest, rollup, sentiment, tickets
from ticketloom.operators.lookup import (
    lemma_table, lexicon_table, severity_table, stopword_table, taxonomy_rules,
)
from ticketloom.operators.taxonomy import categorize, padded_words
from ticketloom.session import materialise, shared_dir, spread

PHRASES = [
    "app keeps crashing on login screen", "Payment failed: credit card error",
    "I can't access my account", "great app love it", "slow loading after update",
    "OTP not received", "server down 503", "service unavailable, oops", "data not loading",
    "no internet connection", "scan the contact number", "nice", "buttons and layout broken",
    "new version will not install", "something went wrong again", "can't change contact details",
    "weird behaviour of the widget", "bad and slow support", "app eka wada nehe", "යෙදුම හොඳයි",
]
FEEDBACK_PHRASES = [3, 11, 17, 18, 19]
# Places of the keywords made of documents, after those of the default taxonomy.
TAIL_FROM = 10_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def padded_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The default taxonomy, and after it the last three cleaned words of every document under their first letter."""
    cleaned = F.trim(padded_words(X.clean_spaced(F.col("text"))))
    tail = F.substring_index("cleaned", " ", -3)
    texts = table(spark, sf, "documents").select((F.col("doc_id") + TAIL_FROM).cast("int").alias("pos"), cleaned.alias("cleaned"))
    tails = materialise(texts.select("pos", tail.alias("keyword")), "tails")  # read several times, the texts once
    return taxonomy_rules(spark).unionByName(tails.withColumn("category", F.concat(F.lit("Tail "), F.left("keyword", F.lit(1)))))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of four files, one a micro-batch: dates come late and out of order."""
    path, events = shared_dir(spark, "event-files"), spark.read.parquet(f"{sf}/events.parquet")
    for piece in range(4):
        part = events.filter(F.pmod(F.hash("event_id"), F.lit(4)) == piece)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def scored_feed(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """The raw feed with the planted class and confidence beside it; ``events`` may be a stream."""
    events = table(spark, sf, "events") if events is None else events
    documents = table(spark, sf, "documents")
    k = F.col("k")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), k % len(PHRASES) + 1)
    body = F.concat(phrase, F.lit("! "), F.col("event_type"), F.lit(" "), F.coalesce("text", F.lit("")))
    user = F.col("user_id").cast("string")
    replied = F.col("event_type") == "purchase"
    known = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).join(
        documents.select("doc_id", "text"), F.col("doc_id") == F.col("event_id"), "left"
    )
    return known.select(
        F.col("event_id").cast("string").alias("reviewId"),
        F.concat(F.lit("user"), user).alias("userName"),
        F.when(k == 17, None).when(k == 23, "").otherwise(body).alias("content"),
        F.when(k % 10 == 0, None).otherwise(1 + F.floor(k / 20)).cast("double").alias("score"),
        F.floor("value").cast("bigint").alias("thumbsUpCount"),
        F.when(k.isin(30, 31), None).otherwise(F.col("ts")).alias("at"),
        F.when(replied, F.concat(F.lit("Noted, user"), user)).alias("replyContent"),
        F.when(replied, F.col("ts") + F.expr("interval 1 day")).alias("repliedAt"),
        F.lit(None).cast("string").alias("userImage"),
        F.lit(None).cast("string").alias("reviewCreatedVersion"),
        F.when(F.col("user_id") % 13 != 0, F.concat(
            F.lit("1."), (F.col("user_id") % 4).cast("string"),
            F.lit("."), (F.col("user_id") % 12).cast("string"),
        )).alias("appVersion"),
        F.when((k % len(PHRASES)).isin(FEEDBACK_PHRASES) | k.isin(17, 23), 0).otherwise(1).alias("is_bug_report"),
        (F.col("value") / (F.col("value") + 1)).alias("bug_confidence"),
    )


def raw_feed(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return scored_feed(spark, sf, events).drop("is_bug_report", "bug_confidence")


def reviews(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return ingest.normalize_feed(raw_feed(spark, sf, events))


def keyed_reviews(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Reviews keyed by user and rating, so that keys repeat; no rating gives a null key."""
    key = F.concat(F.col("user_name"), F.lit(":"), F.col("rating").cast("int").cast("string"))
    return reviews(spark, sf, events).select(
        key.alias("review_id"), F.col("review_id").cast("bigint").alias("feed_id"),
        "review_date", "review_description", "developer_response",
    )


def predictions(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """The scored reviews, in the ``bug_predictions`` columns."""
    feed = ingest.normalize_feed(scored_feed(spark, sf, events))
    clean = feed.withColumn("review_description", X.clean_spaced(F.col("review_description")))
    text = F.col("review_description")
    return clean.select(
        "review_id", "user_name", "review_description", "review_date", "app_version", "rating",
        "is_bug_report", "bug_confidence", X.keyword_count(text).alias("bug_keyword_count"),
        X.text_lengths(text)[0].alias("review_length"),
    )


def categorized(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Bugs with review_id kept beside the ``categorized_bugs`` columns."""
    bugs = tickets.bugs_only(predictions(spark, sf, events))
    found = categorize(bugs, "review_description", taxonomy_rules(spark), cleaned=True)
    return found.select(
        "review_id", "review_description", "bug_category", "review_date", "app_version"
    )


def ticket_view(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    bugs = categorized(spark, sf, events).drop("review_id")
    return tickets.tickets(bugs, severity_table(spark))


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.analyse_feedback(
        predictions(spark, sf), stopword_table(spark), lemma_table(spark), lexicon_table(spark)
    )


def attended(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets of crit level, attended a day after their date, and the id of each user's name.

    A stored table, as in the chain; so is ``sent``.
    """
    made = tickets.by_level(ticket_view(spark, sf), ["crit"]).select(
        "ticket_key", "TicketID", (F.col("review_date") + F.expr("interval 1 day")).alias("attended_at")
    )
    unknown = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("attended_at"))
    rows = made.distinct().unionByName(
        unknown.select(
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("ticket_key"),
            F.concat(F.lit("BUG-user"), F.col("user_id").cast("string")).alias("TicketID"), "attended_at",
        )
    )
    return materialise(rows, "attended")


def sent(spark: SparkSession, sf: str, board: DataFrame | None = None) -> DataFrame:
    """Keys and ids of the err-level tickets, with white space around them, and blanks. ``board`` is a stored ``ticket_view``."""
    made = tickets.by_level(ticket_view(spark, sf) if board is None else board, ["err"])
    blanks = table(spark, sf, "events").filter("event_type = 'view'").select(
        F.lit(" ").alias("ticket_key"), F.lit(" ").alias("ticket_id")
    )
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    rows = made.select(padded("ticket_key").alias("ticket_key"), padded("TicketID").alias("ticket_id"))
    return materialise(rows.unionByName(blanks), "sent")


def legacy_sent(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the old all-digit form, from before there were keys."""
    return table(spark, sf, "events").select(
        F.lit(None).cast("string").alias("ticket_key"),
        F.concat(F.lit("BUG-"), F.col("user_id").cast("string")).alias("ticket_id"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """A report per conversation turn: header case, order and gaps vary with the role and turn."""
    talk = table(spark, sf, "conversations")
    text, role = F.col("text"), F.col("role")
    lines = F.replace(text, F.lit("\n"), F.lit("\n- "))
    items = F.replace(text, F.lit(". "), F.lit(".\n\n"))
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("Critical", "high", "MEDIUM", "low", "to be decided")]),
        (F.col("conv_id") % 5 + 1).cast("int"),
    )
    upper = F.concat(
        F.lit("### 1. SUMMARY: "), text, F.lit("\n\n**KEY FINDINGS:**\n- "), lines,
        F.lit("\n\n### 3. SUGGESTED ACTIONS: "), items, F.lit("\n\n4. PRIORITY LEVEL: "), level,
    )
    lower = F.concat(
        F.lit("summary: "), items, F.lit("\n\nkey findings: "), lines,
        F.lit("\n\npriority level: "), level, F.lit("\n\nbecause of the reports"),
    )
    bare = F.concat(text, F.lit("\n\nSuggested actions\n\n"), items)
    response = F.when(role == "user", upper).when(role == "assistant", lower).otherwise(bare)
    return talk.select("conv_id", "turn", response.alias("response"))


def summaries(spark: SparkSession, sf: str, bugs: DataFrame | None = None) -> DataFrame:
    """Developer summaries whose report texts are made from the rollup's own numbers. ``bugs`` is a stored ``categorized``."""
    rows = rollup.developer_rollup(categorized(spark, sf) if bugs is None else bugs, severity_table(spark))
    number = F.col("bug_count").cast("string")
    level = F.element_at(
        F.create_map(*[F.lit(x) for x in (2, "Critical", 3, "High", 4, "Medium", 6, "whenever")]),
        F.col("severity_code"),
    )
    return rows.select(
        "bug_category", F.col("bug_count").alias("count"),
        F.concat(F.lit("### 1. SUMMARY: "), number, F.lit(" reports of "), F.col("bug_category")).alias("summary"),
        F.concat(F.lit("KEY FINDINGS:\n- versions "), F.col("versions_affected"), F.lit("\n- code "),
                 F.col("severity_code").cast("string")).alias("key_findings"),
        F.concat(F.lit("\"Suggested Actions:** check - fix - test "), number).alias("suggested_actions"),
        F.coalesce(level, F.lit("Unknown")).alias("priority_level"),
        F.lit("from the rollup").alias("additional_notes"),
        "latest_date", "versions_affected", "syslog_level", "severity_code",
    )


def _phrase(number) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (number + 1).cast("int"))


# The last phrase has no Latin letter: cleaned it is empty, and an empty text is not learnt from.
TAUGHT = len(PHRASES) - 1


def training(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled document as a training text whose class its phrase decides: bug or feedback."""
    number = F.col("doc_id") % TAUGHT
    return table(spark, sf, "labels").select(
        "doc_id",
        X.clean_spaced(F.concat(_phrase(number), F.lit(" "), F.col("quality").cast("string"))).alias("processed_review"),
        F.when(number.isin(FEEDBACK_PHRASES), 0).otherwise(1).alias("label"),
    )


def phrase_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews whose text is the phrase of their event alone; its class is known."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").withColumn("k", k)
    return rows.select(
        F.col("event_id").cast("string").alias("review_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        _phrase(F.col("k") % len(PHRASES)).alias("review_description"),
        F.col("ts").alias("review_date"), F.lit("1.0").alias("app_version"),
        F.when(F.col("k") % 10 != 0, F.col("k") % 5 + 1).cast("double").alias("rating"),
    )


# Words of three categories, and of five kinds of text that share none.
CATEGORY_WORDS = {
    "Payment Issue": ["payment", "card", "bill", "recharge"],
    "Server Error": ["server", "timeout", "backend", "gateway"],
    "UI Issue": ["layout", "button", "screen", "interface"],
}
GROUP_WORDS = [
    ["river", "water", "boat"], ["engine", "wheel", "brake"], ["bread", "butter", "honey"],
    ["guitar", "drum", "violin"], ["winter", "snow", "frost"],
]


def planted_bugs(spark: SparkSession, sf: str) -> DataFrame:
    """Bugs whose text is two words of a category; every tenth is given as ``Other``, a few have no category."""
    names = list(CATEGORY_WORDS)
    lists = F.array(*[F.array(*map(F.lit, CATEGORY_WORDS[n])) for n in names])
    own = F.get(lists, (F.col("event_id") % 3).cast("int"))
    word = lambda c: F.get(own, (F.col(c) % 4).cast("int"))
    known = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select(
        F.concat_ws(" ", word("event_id"), word("user_id")).alias("review_description"),
        F.when(F.col("event_id") % 10 == 9, "Other").when(F.col("event_id") % 97 != 5, known).alias("bug_category"),
        F.col("ts").alias("review_date"), F.col("event_id").cast("string").alias("app_version"),
    )


def grouped_texts(spark: SparkSession, sf: str, groups: int = 5) -> DataFrame:
    """A text for every event: the three words of one of the first ``groups`` groups."""
    texts = F.array(*[F.lit(" ".join(words)) for words in GROUP_WORDS])
    return table(spark, sf, "events").select(
        "event_id", F.get(texts, (F.col("user_id") % groups).cast("int")).alias("cleaned_text")
    )
