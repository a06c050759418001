"""Readers, writers and the daily chain."""

import datetime as dt
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketloom import schemas as S
from ticketloom.operators import rollup, tickets
from ticketloom.operators.lookup import severity_table
from ticketloom.plans import daily
from ticketloom.session import materialise, scratch_scope
from ticketloom.sources import readers, versions, writers

ROWS = [
    ('one, "quoted"\nsecond line', "UI Issue", dt.datetime(2024, 1, 2, 3, 4, 5), "1.2"),
    ("null", "Other", None, None),
    ("nan", "Other", dt.datetime(2024, 1, 2, 0, 0, 0, 250000), "n/a"),
]


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "bugs.csv")
    writers.write_csv(spark.createDataFrame(ROWS, S.CATEGORIZED_BUGS), path)
    assert as_set(readers.read_source(spark, path, schema=S.CATEGORIZED_BUGS)) == set(ROWS)


def test_csv_by_name(spark, tmp_path):
    path = tmp_path / "bugs.csv"
    path.write_text('extra,app_version,bug_category,review_description,review_date\n'
                    'x,1,Other,"a ""b""\nc",2024-01-02 03:04:05\ny,2,Other,d,soon\n')
    found = readers.read_source(spark, str(path), schema=S.CATEGORIZED_BUGS)
    assert as_set(found) == {('a "b"\nc', "Other", dt.datetime(2024, 1, 2, 3, 4, 5), "1"), ("d", "Other", None, "2")}
    with pytest.raises(ValueError, match="ticket_id"):
        readers.read_source(spark, str(path), schema=S.SENT_TICKETS)


@pytest.fixture
def small_blocks(spark):
    """Blocks of 300 bytes, so that small files have many."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


TEXTS = ['plain', 'a "quoted" word', 'two\nlines', 'comma, and "both"\n\n\nwith\nmany\nlines', '', None, '"', '""\n"', ' spaced ', 'é\n長 文',
         'x' * 700, 'long\n' * 200, '\n', 'ends in quote"', 'null', 'carriage\r\nreturn']


@pytest.mark.parametrize("files", [1, 3])
def test_csv_by_blocks_is_csv_by_files(spark, tmp_path, small_blocks, files):
    path, kinds = str(tmp_path / "many.csv"), "review_description string, bug_category string, review_date timestamp_ntz, app_version string"
    rows = [(TEXTS[i * 7 % len(TEXTS)], TEXTS[i % len(TEXTS)], dt.datetime(2024, 1, 1 + i % 28) if i % 3 else None, str(i)) for i in range(200)]
    writers.write_csv(spark.createDataFrame(rows, kinds).coalesce(files), path)
    schema = spark.createDataFrame([], kinds).schema
    found, want = readers.read_csv_blocks(spark, path, schema), readers.read_csv(spark, path, schema)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 200
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.rdd.getNumPartitions() > 20  # one file, many tasks
    fewer = readers.read_csv_blocks(spark, path, S.schema_of("app_version string"))
    assert sorted(r.app_version for r in fewer.collect()) == sorted(r[3] for r in rows)


def test_csv_by_blocks_when_blocks_are_joined(spark, tmp_path, small_blocks, monkeypatch):
    path = str(tmp_path / "bugs.csv")
    writers.write_csv(spark.createDataFrame([(f"{t}\n{i}", "c", None, str(i)) for i, t in enumerate(TEXTS * 5)], S.CATEGORIZED_BUGS).coalesce(1), path)
    monkeypatch.setattr(readers, "BROADCAST_BLOCKS", 0)
    assert as_set(readers.read_csv_blocks(spark, path, S.CATEGORIZED_BUGS)) == as_set(readers.read_csv(spark, path, S.CATEGORIZED_BUGS))


def test_csv_by_blocks_refuses_what_it_cannot_cut(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('review,label\n5" screen,1\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        readers.read_csv_blocks(spark, str(tmp_path / "odd.csv"), S.TRAINING)
    (tmp_path / "two.csv").mkdir()
    (tmp_path / "two.csv" / "a.csv").write_text("review,label\none,1\n")
    (tmp_path / "two.csv" / "b.csv").write_text("label,review\n0,two\n")
    with pytest.raises(Exception, match="another header"):
        readers.read_csv_blocks(spark, str(tmp_path / "two.csv"), S.TRAINING).collect()
    (tmp_path / "crlf.csv").write_bytes(b'review,label\r\n"a\r\nb",1\r\nc,0\r\n')
    assert as_set(readers.read_csv_blocks(spark, str(tmp_path / "crlf.csv"), S.TRAINING)) == {("a\r\nb", 1), ("c", 0)}


def test_csv_files_of_other_headers_fail(spark, tmp_path):
    (tmp_path / "two.csv").mkdir()
    (tmp_path / "two.csv" / "a.csv").write_text("review,label\none,1\n")
    (tmp_path / "two.csv" / "b.csv").write_text("label,review\n0,two\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.read_csv(spark, str(tmp_path / "two.csv"), S.TRAINING).collect()


def test_versions_survive_a_dead_writer(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.range(3)
    assert versions.current(spark, path) is None and versions.read_current(spark, path, one.schema).count() == 0
    versions.write_next(one, path)
    versions.write_next(versions.read_current(spark, path, one.schema).union(one), path)
    dead = tmp_path / "t" / "v=000003"
    dead.mkdir()
    (dead / "part-0.parquet").write_text("half a file")
    assert versions.read_current(spark, path, one.schema).count() == 6
    assert versions.write_next(one, path).endswith("v=000004")
    assert versions.read_current(spark, path, one.schema).count() == 3 and not dead.exists()


def test_two_writers_at_once(spark, tmp_path):
    """Both versions stand, in order; changes made out of one version both take effect."""
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        folders = list(pool.map(lambda i: versions.write_next(spark.range(i, i + 1), path, keep=9), range(4)))
    assert sorted(f[-8:] for f in folders) == [f"v={i:06d}" for i in range(1, 5)]
    assert sorted(spark.read.parquet(f).first().id for f in folders) == [0, 1, 2, 3]
    shared, schema = str(tmp_path / "s"), spark.range(1).schema
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: versions.update(spark, shared, schema, lambda df: df.union(spark.range(i, i + 1))), range(4)))
    assert sorted(r.id for r in versions.read_current(spark, shared, schema).collect()) == [0, 1, 2, 3]
    assert not list((tmp_path / "s").glob("_staged*"))


def test_update_begins_again_from_a_version_that_came_between(spark, tmp_path):
    path, schema, calls = str(tmp_path / "t"), spark.range(1).schema, []

    def change(df):
        calls.append(df.count())
        if len(calls) == 1:
            versions.write_next(spark.range(5), path)
        return df.union(spark.range(1))

    assert versions.update(spark, path, schema, change).endswith("v=000002")
    assert calls == [0, 5] and versions.read_current(spark, path, schema).count() == 6


def board(spark, first, last):
    rows = [(f"text {i}", "Other", dt.datetime(2024, 1, i), "1") for i in range(first, last)]
    return tickets.tickets(spark.createDataFrame(rows, S.CATEGORIZED_BUGS), severity_table(spark))


def test_a_digest_counts_once_it_is_out(spark, tmp_path):
    path = str(tmp_path)
    sent = lambda: versions.read_current(spark, f"{path}/sent_tickets", S.SENT_TICKETS).count()
    daily.deliver_digest(spark, board(spark, 1, 15), path)
    assert sent() == 14

    def dies(rows):
        raise OSError("no way out")

    with pytest.raises(OSError):
        daily.deliver_digest(spark, board(spark, 1, 18), path, send=dies)
    assert sent() == 14
    # the tickets come again, with those that came since
    first, old = daily.prepare_digest(spark, board(spark, 1, 18), path)
    assert first.count() == 3 and sent() == 14
    more, new = daily.prepare_digest(spark, board(spark, 1, 20), path)
    assert more.count() == 5
    # in any order, twice, and both at once
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda folder: daily.confirm_digest(spark, folder, path), [new, old]))
    daily.confirm_digest(spark, old, path)
    assert sent() == 19
    out = []
    rows, _ = daily.deliver_digest(spark, board(spark, 1, 21), path, send=lambda df: out.extend(df.collect()))
    assert [r.review_description for r in out] == ["text 20"] and rows.count() == 1 and sent() == 20
    with pytest.raises(ValueError, match="prepare"):
        daily.confirm_digest(spark, f"{path}/digest/v=000099", path)


def test_chain_on_supplied_vectors(spark, tmp_path):
    """Vectors that say the class outright, for the training texts and by review id."""
    said = lambda bad: F.when(bad, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    training = spark.createDataFrame(
        [(f"text {i}", i % 2) for i in range(30)], S.TRAINING
    ).withColumn("given", said(F.col("label") == 1))
    vectors = feed(spark, 40).select(
        F.col("reviewId").alias("review_id"), said(F.col("reviewId").cast("int") % 10 < 5).alias("vector")
    ).filter("review_id <> '7'")
    paths = daily.run_daily(
        spark, feed(spark, 40), training, str(tmp_path / "out"), grid=[1.0], training_vectors="given", review_vectors=vectors
    )
    found = {int(r.review_id): r.is_bug_report for r in spark.read.parquet(paths["bug_predictions"]).collect()}
    # the vectors, not the words, decide; number 3 has no text
    assert all(found[i] == int(i % 10 < 5) for i in range(40) if i not in (3, 7))
    relabelled = spark.read.parquet(paths["reclassified_bugs"])
    assert relabelled.columns == S.RECLASSIFIED_BUGS.names and relabelled.count() == sum(found.values())


def test_file_before_table_before_error(spark, tmp_path):
    df = spark.createDataFrame([("A1", "BUG-1")], S.SENT_TICKETS)
    assert not readers.table_exists(spark, "sent_tickets_test")
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, str(tmp_path / "no"), "sent_tickets_test", S.SENT_TICKETS)
    assert readers.read_sent(spark, table="sent_tickets_test").count() == 0
    spark.sql("CREATE DATABASE IF NOT EXISTS stored LOCATION '%s'" % (tmp_path / "db"))
    writers.write_table(df, "stored.sent_tickets")
    writers.write_table(df.union(df), "stored.sent_tickets")
    assert readers.table_exists(spark, "stored.sent_tickets")
    assert readers.read_sent(spark, str(tmp_path / "no"), "stored.sent_tickets").count() == 2
    path = str(tmp_path / "sent")
    df.write.parquet(path)
    assert readers.read_source(spark, path, "stored.sent_tickets", S.SENT_TICKETS).count() == 1
    writers.write_table(df.withColumnRenamed("ticket_id", "other"), "stored.wrong")
    assert readers.read_sent(spark, table="stored.wrong").count() == 0


def test_history_is_never_replaced_by_nothing(spark, tmp_path):
    path = str(tmp_path / "reviews")
    df = spark.createDataFrame([("A1", "BUG-1")], S.SENT_TICKETS)
    assert writers.replace_unless_empty(df, path)
    assert not writers.replace_unless_empty(df.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_log_file(spark, tmp_path):
    made = tickets.tickets(spark.createDataFrame(ROWS[1:], S.CATEGORIZED_BUGS), severity_table(spark))
    writers.write_lines(tickets.syslog_lines(made), str(tmp_path / "log"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "log")).collect()}
    assert len(lines) == 2 and all(line.startswith("<7> [BUG-") for line in lines)


GOOD = ["great app love it", "very nice and easy", "good service thanks", "best app ever", "love the offers"]
BAD = ["app crash on login screen", "payment failed error", "cannot log in error", "server down again", "otp not received error"]


def feed(spark, n, start=0):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    text = F.element_at(F.array(*[F.lit(t) for t in GOOD + BAD]), (F.col("id") % 10 + 1).cast("int"))
    return spark.range(start, start + n).select(
        F.col("id").cast("string").alias("reviewId"), F.lit("u").alias("userName"),
        F.when(F.col("id") == 3, None).otherwise(text).alias("content"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 5 + 1).cast("double").alias("score"),
        F.lit(0).cast("bigint").alias("thumbsUpCount"),
        (at + F.make_dt_interval(F.col("id").cast("int"))).alias("at"),
        F.lit(None).cast("string").alias("replyContent"), F.lit(None).cast("timestamp_ntz").alias("repliedAt"),
        F.lit(None).cast("string").alias("userImage"), F.lit(None).cast("string").alias("reviewCreatedVersion"),
        F.concat(F.lit("1."), (F.col("id") % 3).cast("string")).alias("appVersion"),
    )


def test_daily_chain_runs_twice(spark, tmp_path):
    training = spark.createDataFrame(
        [(f"{t} {i}", int(t in BAD)) for t in GOOD + BAD for i in range(6)], S.TRAINING
    )
    out = str(tmp_path / "out")
    read = lambda paths: {name: spark.read.parquet(path) for name, path in paths.items()}
    paths = daily.run_daily(spark, feed(spark, 60), training, out, grid=[1.0])
    first = read(paths)
    assert set(first) == {"reviews", "classifier_report", "classifier_scores", "bug_predictions", "prioritized_bugs",
                          "categorized_bugs", "reclassified_bugs", "tickets", "sent_tickets", "digest", "developer_bug_summaries"}
    assert first["bug_predictions"].columns == S.BUG_PREDICTIONS.names
    predictions = {int(r.review_id): r for r in first["bug_predictions"].collect()}
    assert all(predictions[i].is_bug_report == int(i % 10 >= 5) for i in range(60) if i != 3)
    assert (predictions[3].is_bug_report, predictions[3].bug_confidence) == (0, 0.0)
    assert all(p.rating is not None for p in predictions.values())
    assert first["classifier_scores"].filter("chosen = 1").count() == 1
    assert first["categorized_bugs"].columns == S.CATEGORIZED_BUGS.names
    assert first["reclassified_bugs"].filter("bug_category = 'Other'").count() == 0
    assert first["developer_bug_summaries"].columns == S.DEVELOPER_SUMMARIES.names
    # the first digest sends the ten newest, and all count as sent
    assert first["digest"].count() == 10 and first["sent_tickets"].count() == 30

    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda prompt: None if "Server" in prompt else "summary: in short\n\npriority level: high")

    texts = spark.createDataFrame([("61", "in other words")], "review_id string, translated string")
    paths = daily.run_daily(
        spark, feed(spark, 20, start=50), training, out, grid=[1.0], summariser=model, translations=texts
    )
    second = read(paths)
    assert second["reviews"].count() == 70
    assert second["digest"].count() == 5 and second["sent_tickets"].count() == 35
    reports = {r.bug_category: r for r in second["developer_bug_summaries"].collect()}
    assert reports["Server Error"].additional_notes == rollup.FAILED_SUMMARY["additional_notes"]
    assert reports["Payment Issue"].summary == "in short" and reports["Payment Issue"].priority_level == "High"
    assert second["translated_reviews"].count() == 70
    with pytest.raises(ValueError, match="empty"):
        daily.run_daily(spark, feed(spark, 0), training, out)
    assert spark.read.parquet(paths["reviews"]).count() == 70


def test_scratch_is_removed_with_its_scope(spark):
    with scratch_scope(spark):
        kept = materialise(spark.range(5), "scratch")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 5 and readers.path_exists(spark, path)
    assert not readers.path_exists(spark, path)


def test_scopes_of_two_threads_are_apart(spark):
    def keep(_):
        return materialise(spark.range(3), "kept")

    with ThreadPoolExecutor(1) as pool, scratch_scope(spark):
        kept = pool.submit(keep, 0).result()
    assert kept.count() == 3


def test_attended_state_is_stored(spark, tmp_path):
    wanted = spark.createDataFrame([("A1", "BUG-1")], "ticket_key string, TicketID string")
    for at in ("2024-01-01 00:00:00", "2024-02-01 00:00:00"):
        folder = daily.attend(spark, wanted, at, str(tmp_path))
    assert [str(r.attended_at) for r in spark.read.parquet(folder).collect()] == ["2024-01-01 00:00:00"]


def test_a_text_taken_whole(spark):
    made = rollup.summary_sections(
        spark.createDataFrame([("A", "all of it"), ("B", None)], "bug_category string, response string"), parsed=False
    )
    found = {r.bug_category: (r.summary, r.key_findings, r.priority_level) for r in made.collect()}
    assert found == {"A": ("all of it", "N/A", "Unknown"),
                     "B": tuple(rollup.FAILED_SUMMARY[c] for c in ("summary", "key_findings", "priority_level"))}
