"""Ingest, tickets, state, aggregates, rollup and language on small literal tables."""

import datetime as dt
import hashlib
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ticketloom.functions import dates as D
from ticketloom.operators import aggregates, ingest, language, rollup, sentiment, state, tickets
from ticketloom.operators.lookup import (
    lemma_table, lexicon_table, severity_table, small_table, stopword_table,
)
from ticketloom import schemas as S

ts = dt.datetime.fromisoformat


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- ingest ------------------------------------------------------------------------------------

def test_feed_without_the_dropped_columns(spark):
    raw = spark.createDataFrame([("r1", "u", "text", 5.0)], "reviewId string, userName string, content string, score double")
    made = ingest.normalize_feed(raw)
    assert made.columns == [
        "source", "review_id", "review_title", "user_name", "review_description", "rating",
        "language_code", "country_code",
    ]
    assert made.first().source == "Google Play" and made.first().review_title is None


def test_required_and_available_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ingest.available_columns(df, ["b", "z", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="z"):
        ingest.require_columns(df, ["a", "z"])


REVIEW = "review_id string, review_date timestamp_ntz, v int"


def test_upsert_rules(spark):
    old = spark.createDataFrame(
        [("a", ts("2024-01-01"), 1), ("b", ts("2024-03-01"), 2), ("c", None, 3), (None, ts("2024-01-01"), 4)], REVIEW
    )
    new = spark.createDataFrame(
        [("a", ts("2024-02-01"), 10), ("b", ts("2024-02-01"), 20), ("c", ts("2024-05-01"), 30),
         (None, ts("2024-02-01"), 40), ("d", None, 50), ("d", ts("2024-01-01"), 60)], REVIEW
    )
    once = ingest.upsert_latest(old, new)
    expected = {("a", 10), ("b", 2), ("c", 3), (None, 40), ("d", 50)}
    assert {(r.review_id, r.v) for r in once.collect()} == expected
    twice = ingest.upsert_latest(once, new)
    assert {(r.review_id, r.v) for r in twice.collect()} == expected


def test_upsert_prefers_incoming_and_fills_columns(spark):
    old = spark.createDataFrame([("a", ts("2024-01-01"), 1)], REVIEW)
    new = spark.createDataFrame([("a", ts("2024-01-01"), "x")], "review_id string, review_date timestamp_ntz, w string")
    assert rows(ingest.upsert_latest(old, new).select("review_id", "v", "w")) == [("a", None, "x")]


def test_impute_median(spark):
    df = spark.createDataFrame([("1",), ("4",), ("5",), ("2",), ("n/a",), (None,)], "rating string")
    assert sorted(r.rating for r in ingest.impute_rating(df).collect()) == [1.0, 2.0, 3.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize("values", [
    [], [5.0], [1.0, 9.0], [1.0, 2.0, 2.0, 3.0], [2.0] * 50 + [3.0] * 50, [1.0] * 999 + [7.0], [float("-inf"), 1.0, float("inf")],
    [float((i * 7919) % 5003) for i in range(5003)], [((i * 7919) % 3001 - 1500) ** 3 / 1e6 for i in range(3000)],
], ids=len)
def test_median_of_ranges(spark, values):
    """Ties, even counts, one value, values over many ranges; nulls do not count."""
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    found = spark.range(1).select(ingest.median_of(df, F.col("x")).alias("m")).first().m
    assert found == (None if not values else pytest.approx(statistics.median(values), rel=1e-15))


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(ingest.profile_nulls(df), "column_name") == [("a", 1, 2), ("b", 2, 2)]


def test_dates(column, spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05.25", "2024-01-02", "soon", None]
    assert column(D.parse_ts, texts) == [
        ts("2024-01-02 03:04:05"), ts("2024-01-02 03:04:05.250"), ts("2024-01-02"), None, None,
    ]
    with pytest.raises(PySparkException, match="not a timestamp"):
        column(lambda c: D.parse_ts(c, strict=True), texts)


def test_week_edges(column):
    found = column(lambda c: D.week_ending(c.cast("timestamp_ntz")), ["2024-01-07 23:59:59", "2024-01-08 00:00:00"])
    assert found == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]


# --- tickets -----------------------------------------------------------------------------------

BUGS = "review_id string, review_description string, bug_category string, review_date timestamp_ntz, app_version string"


def bug(i, category, date=None, version=None, text="t"):
    return (str(i), text, category, ts(date) if date else None, version)


def test_ticket_id_hash(spark):
    df = spark.createDataFrame([bug(1, "Other", "2024-01-02 03:04:05", "1.2", "app crash"), bug(2, "Other", text=None)], BUGS)
    found = [r.TicketID for r in tickets.with_ticket_id(df).orderBy("review_id").collect()]
    expected = ["app crash_2024-01-02 03:04:05_1.2", "nan_nan_nan"]
    assert found == ["BUG-" + hashlib.sha1(x.encode()).hexdigest()[:8].upper() for x in expected]
    keys = [r.ticket_key for r in tickets.with_ticket_id(df).orderBy("review_id").collect()]
    assert keys == [hashlib.sha1(x.encode()).hexdigest().upper() for x in expected]


def test_syslog_lines(spark):
    df = spark.createDataFrame([bug(1, "Crash/Freeze", "2024-01-02 03:04:05", "1.2", "boom"), bug(2, "UI Issue", text=None)], BUGS)
    made = tickets.newest_first(tickets.tickets(df, severity_table(spark)))
    ids = [r.TicketID for r in made.collect()]
    assert [r.value for r in tickets.syslog_lines(made).collect()] == [
        f"<2> [{ids[0]}] (CRIT) Crash/Freeze in v1.2 on 2024-01-02: boom",
        f"<6> [{ids[1]}] (INFO) UI Issue in vnan on N/A: nan",
    ]


def test_filters(spark):
    df = spark.createDataFrame([
        bug(1, "A", "2024-01-01", " 1.2 "), bug(2, "A", "2024-01-02", None), bug(3, "B", "2024-01-03", "1.2"),
    ], BUGS)
    assert rows(tickets.by_version_category(df, ["1.2"], ["A"]).select("review_id")) == [("1",)]
    assert tickets.by_date(df, ts("2024-01-02"), ts("2024-01-03")).count() == 2


def test_dimension_rows_listed_twice_do_not_multiply(spark):
    df = spark.createDataFrame([bug(1, "Other"), bug(2, None)], BUGS)
    twice = severity_table(spark).union(severity_table(spark))
    assert tickets.tickets(df, twice).count() == 2
    tagged = spark.createDataFrame([("1", "text", "si")], "review_id string, t string, detected_language string")
    texts = spark.createDataFrame([("1", "b"), ("1", "a"), (None, "c")], "review_id string, translated string")
    assert [r.translated_review for r in language.translation_route(tagged, "t", texts).collect()] == ["a"]


# --- state -------------------------------------------------------------------------------------

def test_mark_attended_appends_once(spark):
    attended = spark.createDataFrame(
        [("A1", "BUG-1", ts("2024-01-01")), (None, None, ts("2024-01-01"))], S.ATTENDED_TICKETS
    )
    # A2 shows the id of A1 and is another ticket
    ids = spark.createDataFrame(
        [("A1", "BUG-1"), ("A2", "BUG-1"), ("A2", "BUG-1"), (None, "BUG-1")], "ticket_key string, TicketID string"
    )
    after = state.mark_attended(attended, ids, ts("2024-06-01"))
    assert sorted(map(str, rows(after))) == sorted(map(str, [
        ("A1", "BUG-1", ts("2024-01-01")), (None, None, ts("2024-01-01")), ("A2", "BUG-1", ts("2024-06-01")),
    ]))
    assert state.mark_attended(after, ids, ts("2024-07-01")).count() == 3


def test_attended_report_fans_out_and_keeps_unknown(spark):
    df = spark.createDataFrame([bug(1, "Other", "2024-01-01", "1"), bug(2, "Other", "2024-01-01", "1"), bug(3, "Other")], BUGS)
    made = tickets.tickets(df, severity_table(spark))
    shared = tickets.with_ticket_id(df).filter("review_id = '1'").first()
    attended = spark.createDataFrame([
        (shared.ticket_key, shared.TicketID, ts("2024-02-01")), ("x", "BUG-x", ts("2024-03-01")), (None, None, ts("2024-01-01")),
        ("another", shared.TicketID, ts("2023-01-01")),
    ], S.ATTENDED_TICKETS)
    found = state.attended_report(attended, made).collect()
    assert [(r.TicketID, r.bug_category) for r in found] == [
        ("BUG-x", None), (shared.TicketID, "Other"), (shared.TicketID, "Other"), (None, None), (shared.TicketID, None),
    ]


def test_tickets_of_one_shown_id_are_all_delivered(spark):
    """Keys that agree in their first eight digits, as two tickets of the test tables do."""
    made = spark.createDataFrame([
        (f"D7EA4DE0{i}", "BUG-D7EA4DE0", "Other", "1", ts("2024-01-01"), f"text {i}", level) for i, level in enumerate(["err", "crit"])
    ], "ticket_key string, TicketID string, bug_category string, app_version string, review_date timestamp_ntz, "
       "review_description string, syslog_level string")
    done = made.filter("syslog_level = 'err'").select("ticket_key", F.col("TicketID").alias("ticket_id"))
    assert [r.review_description for r in state.new_tickets(made, done).collect()] == ["text 1"]
    rows_, after = state.digest(made, done)
    assert rows_.count() == 1 and after.count() == 2
    old = spark.createDataFrame([(" BUG-D7EA4DE0 ",), ("",)], "ticket_id string")
    assert state.adopt_sent(old, made).count() == 2


@pytest.mark.parametrize("ids,first", [
    ([], True), (["BUG-123", " BUG-4 "], True), (["BUG-123", "BUG-00FFAA11"], False), ([" ", None], True),
])
def test_digest_mode(spark, ids, first):
    sent = spark.createDataFrame([(None, i) for i in ids], S.SENT_TICKETS)
    assert state.digest_mode(sent).first().first_run is first


def test_two_digests(spark):
    df = spark.createDataFrame([bug(i, "Other", f"2024-01-{i:02d}", "1", f"t{i}") for i in range(1, 15)], BUGS)
    made = tickets.tickets(df, severity_table(spark))
    empty = spark.createDataFrame([], S.SENT_TICKETS)
    first, sent = state.digest(made, empty)
    assert [r.review_description for r in first.collect()] == [f"t{i}" for i in range(14, 4, -1)]
    assert sent.count() == 14
    later, same = state.digest(made, sent)
    assert later.count() == 0 and same.count() == 14
    more = spark.createDataFrame([bug(20, "Other", None, "2", "fresh")], BUGS)
    grown = made.unionByName(tickets.tickets(more, severity_table(spark)))
    later, after = state.digest(grown, sent)
    assert [r.review_description for r in later.collect()] == ["fresh"] and after.count() == 15
    assert later.columns == state.DIGEST_COLUMNS


# --- aggregates --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([
        bug(1, "A", "2024-01-01 10:00:00", "1.9"), bug(2, "A", "2024-02-01 10:00:00", "1.10"),
        bug(3, "B", "2024-01-01 11:00:00", "1.9"), bug(4, "B", None, None), bug(5, "A", "2024-01-03", "1.9"),
    ], BUGS)


def test_grids(few):
    grid = rows(aggregates.version_category_grid(few), "app_version", "bug_category")
    assert grid == [("1.10", "A", 1), ("1.10", "B", 0), ("1.9", "A", 2), ("1.9", "B", 1)]
    by_day = {(d, c): n for d, c, n in rows(aggregates.day_category_grid(few))}
    assert len(by_day) == 62
    assert by_day[1, "A"] == 2 and by_day[1, "B"] == 1 and by_day[3, "A"] == 1
    assert by_day[3, "B"] is None and by_day[2, "A"] == 0 and by_day[31, "B"] == 0
    filled = {(d, c): n for d, c, n in rows(aggregates.day_category_grid(few, zero_fill=True))}
    assert filled[3, "B"] == 0 and sum(filled.values()) == 4


def test_counts_and_share(few):
    assert rows(aggregates.bugs_per_category(few)) == [("A", 3), ("B", 2)]
    share = {c: s for c, _, s in rows(aggregates.category_share(few))}
    assert share == {"A": 0.6, "B": 0.4}
    assert rows(aggregates.dimension_values(few, "bug_category")) == [("A",), ("B",)]
    assert rows(aggregates.date_bounds(few)) == [(ts("2024-01-01 10:00:00"), ts("2024-02-01 10:00:00"))]


def test_weeks(few):
    assert rows(aggregates.weekly_counts(few), "week_end", "bug_category") == [
        (dt.date(2024, 1, 7), "1.9", "A", 2), (dt.date(2024, 1, 7), "1.9", "B", 1),
        (dt.date(2024, 2, 4), "1.10", "A", 1),
    ]


def test_kpis(few):
    chosen = tickets.by_version_category(few, ["1.9"], ["A"])
    assert rows(aggregates.kpis(chosen, few)) == [(2, 2, 2, "1.10")]
    assert rows(aggregates.kpis(chosen, few, ["1.9"], ["A"])) == [(2, 1, 1, "1.10")]
    none = few.filter("app_version = 'x'")
    assert rows(aggregates.kpis(none, none)) == [(0, 0, 0, "N/A")]


def test_versions(spark):
    df = spark.createDataFrame([(" 1.2 ",), ("1.10",), ("1.2",), ("",), (None,), ("1.x",)], "app_version string")
    assert [r.app_version for r in aggregates.versions_sorted(df).collect()] == ["1.2", "1.10", "1.x"]


def test_bug_rate(spark):
    schema = "is_bug_report int, bug_confidence double"
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8)], schema)
    found = aggregates.bug_rate(df).first()
    assert (found.total_reviews, found.bug_count, found.high_confidence) == (3, 2, 1)
    assert found.bug_percentage == pytest.approx(200 / 3)
    assert tuple(aggregates.bug_rate(df.limit(0)).first()) == (0, 0, 0.0, 0)


def test_classification_report(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2 + [(0, 2)]
    df = spark.createDataFrame(pairs, "y int, p int")
    found = {r["class"]: r for r in aggregates.classification_report(df, "y", "p").collect()}
    assert (found["1"].precision, found["1"].recall, found["1"].support) == (0.6, 0.75, 4)
    assert found["0"].recall == pytest.approx(4 / 7) and found["2"].f1 == 0
    assert found["accuracy"].f1 == pytest.approx(7 / 11) and found["accuracy"].support == 11
    assert found["macro avg"].precision == pytest.approx((0.6 + 0.8 + 0) / 3)
    assert found["weighted avg"].recall == pytest.approx(7 / 11)


# --- sentiment ---------------------------------------------------------------------------------

TEXTS = [("1", "The apps are great, great but slow!"), ("2", None), ("3", "Nothing known"), ("4", "not cannot bugs")]


def scored(spark, pad=0):
    df = spark.createDataFrame(TEXTS, "review_id string, text string")
    grow = lambda table, make: table.unionByName(small_table(spark, [make(i) for i in range(pad)], table.schema))
    stop = grow(stopword_table(spark), lambda i: (f"zz{i}",))
    lemma = grow(lemma_table(spark), lambda i: (f"zz{i}s", f"zz{i}"))
    lexicon = grow(lexicon_table(spark), lambda i: (f"zz{i}", 0.5))
    text = sentiment.clean_lemmas(df, "text", stop, lemma)
    made = sentiment.score_sentiment(text, "cleaned_text", lexicon)
    return [(r.cleaned_text, round(r.sentiment_score, 6)) for r in made.orderBy("review_id").collect()]


def test_lemmas_and_scores_by_literal_and_by_join(spark):
    expected = [("app great great slow", round((0.8 + 0.8 - 0.3) / 3, 6)), ("", 0.0), ("nothing known", 0.0), ("bug", 0.0)]
    assert scored(spark) == expected
    assert scored(spark, pad=1200) == expected


@pytest.mark.parametrize("pad", [0, 1200])
def test_lookups_mean_the_same_at_any_size(spark, pad):
    """Null and repeated ids keep their own texts; a token listed twice counts once."""
    df = spark.createDataFrame([(None, "apps good"), (None, "bad"), ("1", "good good bad"), ("1", None)], "review_id string, text string")
    more = [(f"zz{i}",) for i in range(pad)]
    lemma = spark.createDataFrame([("apps", "app"), ("apps", "zap")] + [(t, t) for t, in more], "token string, lemma string")
    lexicon = spark.createDataFrame([("good", 0.7), ("good", 0.9), ("bad", -0.7)] + [(t, 0.1) for t, in more], "token string, polarity double")
    stop = spark.createDataFrame([("the",), ("the",), (None,)] + more, "token string")
    text = sentiment.clean_lemmas(df, "text", stop, lemma)
    found = sentiment.score_sentiment(text, "cleaned_text", lexicon).select("cleaned_text", F.round("sentiment_score", 4)).collect()
    assert sorted(map(tuple, found)) == [("", 0.0), ("app good", 0.7), ("bad", -0.7), ("good good bad", 0.2333)]


def test_months_without_reviews(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-31 23:00:00"), 0.5), (ts("2024-03-01"), -0.5), (ts("2024-01-01"), 0.0), (None, 1.0)],
        "review_date timestamp_ntz, sentiment_score double",
    )
    assert rows(sentiment.monthly_sentiment(df), "month_end") == [
        (dt.date(2024, 1, 31), 0.25, 2), (dt.date(2024, 2, 29), None, 0), (dt.date(2024, 3, 31), -0.5, 1),
    ]


def test_distribution_keeps_empty_buckets(spark):
    df = spark.createDataFrame([("Neutral",), ("Neutral",), (None,)], "sentiment_category string")
    assert rows(sentiment.sentiment_distribution(df)) == [("Negative", 0), ("Neutral", 2), ("Positive", 0)]


# --- rollup ------------------------------------------------------------------------------------

def test_rollup_versions_first_seen(spark):
    df = spark.createDataFrame([
        bug(1, "A", "2024-01-05", "2.0"), bug(2, "A", "2024-01-01", "3.0"), bug(3, "A", "2024-01-05", "1.0"),
        bug(4, "A", "2024-02-01", "3.0"), bug(5, "A", None, "0.1"), bug(6, "A", "2024-01-01", None),
        bug(7, "OTP Issue", None, None),
    ], BUGS)
    found = {r.bug_category: r for r in rollup.developer_rollup(df, severity_table(spark)).collect()}
    assert (found["A"].bug_count, found["A"].versions_affected) == (6, "3.0, 1.0, 2.0, 0.1")
    assert found["A"].latest_date == ts("2024-02-01") and found["A"].syslog_level == "debug"
    assert (found["OTP Issue"].versions_affected, found["OTP Issue"].severity_code) == ("", 4)


def test_sample_is_stable_and_bounded(spark):
    df = spark.createDataFrame([bug(i, "A" if i % 3 else "B", "2024-01-01", "1", f"text {i}") for i in range(100)], BUGS)
    drawn = {(r.bug_category, r.sample_rank, r.review_id) for r in rollup.category_sample(df, 25).collect()}
    again = {(r.bug_category, r.sample_rank, r.review_id) for r in rollup.category_sample(df.repartition(7), 25).collect()}
    assert drawn == again and len(drawn) == 50
    context = {r.bug_category: r for r in rollup.summary_context(df, n=2).collect()}
    assert context["A"].reviews == 2
    assert context["A"].context.startswith("Review 1 (Date: 2024-01-01 00:00:00, Version: 1): text ")
    plain = rollup.summary_context(df, n=2, numbered=False).first().context
    assert plain.startswith("text ") and "\n\ntext " in plain


REPORT = (
    "### 1. SUMMARY: It fails.\n\nmore ****text\n\n**KEY FINDINGS:**\n- a\n\n"
    "3. suggested actions: fix\n\n4. Priority Level: HIGH, not low\n\nbecause"
)


def test_sections(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "no header"), (3, None), (4, "summary: a\n\nx\n\nsummary: b\n\n\n\ny"),
                                (5, "priority level: to be decided")], "id int, response string")
    found = {r.id: r for r in rollup.parse_sections(df).collect()}
    one = found[1]
    assert one.summary == "SUMMARY: It fails.\nmore text"
    assert one.key_findings == "KEY FINDINGS:**\n- a"
    assert one.suggested_actions == "fix"
    # continuation after the level makes the level an unknown word
    assert one.priority_level == "High\nbecause" and one.additional_notes == "Priority Level: HIGH, not low"
    assert all(found[i].summary == "" for i in (2, 3))
    assert found[4].summary == "b\ny"
    assert (found[5].priority_level, found[5].additional_notes) == ("Unknown", "to be decided")


def test_summaries_order_export_and_insights(spark):
    per_category = spark.createDataFrame(
        [("Crash/Freeze", 2, ts("2024-01-01"), "1", "crit", 2), ("New", 1, None, "", "debug", 7)],
        "bug_category string, bug_count bigint, latest_date timestamp_ntz, versions_affected string, syslog_level string, severity_code int",
    )
    sections = spark.createDataFrame(
        [("New", "s", "k\n- x", "a", "Critical", "n")],
        "bug_category string, summary string, key_findings string, suggested_actions string, priority_level string, additional_notes string",
    )
    made = rollup.developer_summaries(per_category, sections)
    assert made.columns == S.DEVELOPER_SUMMARIES.names
    assert [r.bug_category for r in rollup.order_by_priority(made).collect()] == ["New", "Crash/Freeze"]
    assert rollup.developer_summaries(per_category).filter("priority_level = 'Unknown'").count() == 2
    assert rollup.export_summary(made.withColumn("review_description", F.lit("x")), "New").columns == made.columns
    known = {tuple(r) for r in rollup.insights_by_severity(made, severity_table(spark)).collect()}
    assert known == {("Crash/Freeze", "crit", 2), ("New", "unknown", 0)}
    bugs = spark.createDataFrame([bug(1, "New"), bug(2, "New"), bug(3, "Else")], BUGS)
    assert [(r.bug_category, r.bug_count) for r in rollup.category_insights(made, bugs, severity_table(spark)).collect()] == [("New", 2)]
    model = lambda batches: (b.str.upper() for b in batches)
    context = spark.createDataFrame([("New", "some text")], "bug_category string, context string")
    from collections.abc import Iterator

    import pandas as pd

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return model(batches)

    assert rows(rollup.summarise_with(context, typed)) == [("New", "SOME TEXT")]


# --- language ----------------------------------------------------------------------------------

def test_language_and_route(spark):
    df = spark.createDataFrame([
        ("1", "යෙදුම හොඳයි", "en"), ("2", "app eka wada nehe", "en"), ("3", "wada", "fr"), ("4", "fine", None),
        ("5", "123 !!", "en"), ("6", None, "en"), ("7", "good app", "en"),
    ], "review_id string, text string, lang string")
    tagged = language.language_tag(df, "text", "lang")
    translations = spark.createDataFrame([("1", "the app is good"), ("7", "unused")], "review_id string, translated string")
    found = {r.review_id: r for r in language.translation_route(tagged, "text", translations).collect()}
    assert [found[str(i)].detected_language for i in range(1, 8)] == ["si", "en", "fr", "unknown", "unknown", "unknown", "en"]
    assert [found[str(i)].route for i in range(1, 8)] == ["translate"] * 2 + ["keep"] * 5
    assert (found["1"].translated_review, found["1"].src_lang, found["1"].is_singlish) == ("the app is good", "si", False)
    assert (found["2"].translated_review, found["2"].src_lang, found["2"].is_singlish) == ("", "auto", True)
    assert found["3"].is_singlish is False and found["7"].translated_review == "good app"
    assert language.translation_route(tagged, "text").count() == 7
