"""Each stream equals its batch twin, however the files are cut and whenever it restarts."""

import shutil

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import aggregates, ingest, state, tickets
from ticketloom.operators.lookup import severity_table
from ticketloom.sources import deltas
from ticketloom.streaming import jobs


@pytest.fixture(scope="module")
def bugs(spark):
    i = F.col("id")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (i * 7 % 900).cast("int"))
    return spark.range(400).select(
        (i % 90).cast("string").alias("review_id"), i.alias("feed_id"),
        F.concat(F.lit("text "), (i % 60).cast("string")).alias("review_description"),
        F.when(i % 3 == 0, "UI Issue").when(i % 3 == 1, "Other").otherwise("Login Error").alias("bug_category"),
        F.when(i % 50 != 9, at).alias("review_date"),
        F.when(i % 11 != 0, F.concat(F.lit("1."), (i % 3).cast("string"))).alias("app_version"),
    ).cache()


def pieces(df, path, order, n):
    """The table as ``n`` folders of files, in the order given."""
    for k in range(n):
        df.filter(F.pmod(order, F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def as_set(df):
    return sorted(map(str, df.collect()))



@pytest.mark.parametrize("cut,n", [(0, 4), (1, 5)])
def test_upsert(spark, bugs, tmp_path, cut, n):
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    order = [F.hash("feed_id"), (F.col("feed_id") / 80).cast("int")][cut]
    pieces(bugs, path, order, n)
    run = lambda: jobs.stream_upsert(
        stream_of(spark, bugs, path), target, str(tmp_path / "log"), tiebreak=["feed_id"], buckets=4
    ).awaitTermination()
    run()
    found = spark.read.schema(bugs.schema).parquet(target).select(*bugs.columns)
    batch = ingest.upsert_latest(bugs.limit(0), bugs, tiebreak=["feed_id"]).select(*bugs.columns)
    assert as_set(found) == as_set(batch)
    size = found.count()
    # a later delivery, after a restart
    later = bugs.withColumn("review_date", F.lit("2025-01-01").cast("timestamp_ntz")).filter("review_id < '3'")
    later.coalesce(1).write.mode("append").parquet(path)
    run()
    again = spark.read.schema(bugs.schema).parquet(target)
    # an undated row stays ahead of any date
    newer = again.filter("review_id < '3' AND (review_date >= '2025-01-01' OR review_date IS NULL)")
    assert newer.count() == later.select("review_id").distinct().count()
    assert again.count() == size


def test_a_staged_batch_is_finished(spark, bugs, tmp_path):
    path, target, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    pieces(bugs, path, F.lit(0), 1)
    done = ingest.upsert_latest(bugs.limit(0), bugs).withColumn("bucket", jobs._bucket("review_id", 4))
    done.withColumn("app_version", F.lit("staged")).write.partitionBy("bucket").parquet(f"{log}/staged/batch=0")
    jobs.stream_upsert(stream_of(spark, bugs, path), target, log, buckets=4).awaitTermination()
    assert [r[0] for r in spark.read.parquet(target).select("app_version").distinct().collect()] == ["staged"]


def test_new_tickets_once(spark, bugs, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    pieces(bugs, path, F.hash("feed_id"), 4)
    make = lambda df: tickets.tickets(df, severity_table(spark))
    sent = make(bugs.filter("bug_category = 'Other'")).select("ticket_key", F.col("TicketID").alias("ticket_id"))
    run = lambda: jobs.stream_new_tickets(
        make(stream_of(spark, bugs, path)), sent, target, str(tmp_path / "log")
    ).awaitTermination()
    run()
    expected = state.new_tickets(make(bugs), sent).select("ticket_key").distinct()
    found = spark.read.parquet(target).select("ticket_key")
    assert as_set(found) == as_set(expected)
    # the same bugs again, under other file names, are not new
    bugs.coalesce(1).write.mode("append").parquet(path)
    run()
    assert spark.read.parquet(target).count() == expected.count()


def test_new_tickets_once_without_reading_what_was_emitted(spark, bugs, tmp_path):
    """The state alone knows the keys: a batch's folder that is gone is not missed, and no key comes twice."""
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda df: tickets.tickets(df, severity_table(spark))
    sent = make(bugs.filter("bug_category = 'Other'")).select("ticket_key", F.col("TicketID").alias("ticket_id"))
    run = lambda: jobs.stream_new_tickets(
        make(stream_of(spark, bugs, path)), sent, target, str(tmp_path / "log"), delay=None
    ).awaitTermination()
    pieces(bugs, path, F.hash("feed_id"), 2)
    run()
    first = spark.read.parquet(target).select("ticket_key", "batch_id").collect()
    expected = state.new_tickets(make(bugs), sent).select("ticket_key").distinct().collect()
    assert sorted(r.ticket_key for r in first) == sorted(r.ticket_key for r in expected)
    shutil.rmtree(tmp_path / "out" / "batch_id=0")
    bugs.coalesce(1).write.mode("append").parquet(path)
    run()
    left = sorted(r.ticket_key for r in spark.read.parquet(target).select("ticket_key").collect())
    assert left == sorted(r.ticket_key for r in first if r.batch_id > 0)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_weekly_counts_lose_nothing(spark, bugs, tmp_path, zone):
    """One date far in the future comes first; all others are then late."""
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    future = bugs.limit(1).withColumn("review_date", F.lit("2099-01-05").cast("timestamp_ntz")).withColumn("app_version", F.lit("9"))
    future.coalesce(1).write.parquet(path)
    pieces(bugs, path, F.hash("feed_id"), 3)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        jobs.stream_weekly_counts(stream_of(spark, bugs, path), target, str(tmp_path / "log")).awaitTermination()
        names = ["week_end", "app_version", "bug_category", "bug_count"]
        assert as_set(jobs.current_weekly_counts(spark, target).select(*names)) == as_set(
            aggregates.weekly_counts(bugs.unionByName(future)).select(*names)
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- deltas -------------------------------------------------------------------------------------

def upserted(spark, bugs, path, target, log, **more):
    jobs.stream_upsert_deltas(stream_of(spark, bugs, path), target, log, tiebreak=["feed_id"], **more).awaitTermination()
    return jobs.current_reviews(spark, target, bugs.schema, tiebreak=["feed_id"])


@pytest.mark.parametrize("cut,n,ratio", [(0, 4, 0.5), (1, 5, 0.5), (0, 4, float("inf")), (0, 3, 0.0)])
def test_upsert_by_deltas(spark, bugs, tmp_path, cut, n, ratio):
    path, target, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    keyed = bugs.withColumn("review_id", F.when(F.col("review_id") != "7", F.col("review_id")))  # a null key too
    pieces(keyed, path, [F.hash("feed_id"), (F.col("feed_id") / 80).cast("int")][cut], n)
    found = upserted(spark, keyed, path, target, log, ratio=ratio)
    batch = ingest.upsert_latest(keyed.limit(0), keyed, tiebreak=["feed_id"])
    assert as_set(found.select(*keyed.columns)) == as_set(batch.select(*keyed.columns))
    base, left = deltas.generation(spark, target)
    assert (base is None) == (ratio == float("inf")) and (ratio != 0.0 or not left)
    some = jobs.current_reviews(spark, target, keyed.schema, tiebreak=["feed_id"], bounds=("2", "35"))
    assert as_set(some.select(*keyed.columns)) == as_set(batch.filter("review_id BETWEEN '2' AND '35'").select(*keyed.columns))


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """The same small batch after a small and after a large history."""
    sizes = []
    for n in (1_000, 100_000):
        where = tmp_path / str(n)
        rows = lambda a, b: spark.range(a, b).select(
            F.col("id").cast("string").alias("review_id"), F.sha1(F.col("id").cast("string")).alias("body"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("review_date"),
        )
        fold = jobs._latest("review_id", None)
        deltas.append(rows(0, n), str(where), 0, "review_id", fold)
        deltas.compact(spark, str(where), rows(0, 1).schema, "review_id", fold)
        before = folder_bytes(where)
        deltas.append(rows(n - 50, n + 50), str(where), 1, "review_id", fold)
        sizes.append(folder_bytes(where) - before)
        assert deltas.read(spark, str(where), rows(0, 1).schema, "review_id", fold).count() == n + 50
        plan = deltas.read(spark, str(where), rows(0, 1).schema, "review_id", fold)
        assert not deltas.due(spark, str(where)) or n == 1_000
        assert plan.select("review_id").distinct().count() == n + 50
    assert sizes[1] < 2 * sizes[0]


def test_a_compaction_that_dies_changes_nothing(spark, bugs, tmp_path, monkeypatch):
    path, target, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    pieces(bugs, path, F.hash("feed_id"), 3)
    kept = deltas._write

    def dies(df, path, name, key):
        if name.startswith("base"):
            df.limit(5).write.mode("overwrite").parquet(f"{path}/{name}")
            (tmp_path / "out" / name / "_SUCCESS").unlink()
            raise OSError("lost in the middle of a compaction")
        kept(df, path, name, key)

    monkeypatch.setattr(deltas, "_write", dies)
    with pytest.raises(Exception, match="middle of a compaction"):
        upserted(spark, bugs, path, target, log)
    expected = lambda rows: as_set(ingest.upsert_latest(rows.limit(0), rows, tiebreak=["feed_id"]).select(*bugs.columns))
    base, left = deltas.generation(spark, target)
    assert base is None and left == [0, 1]
    monkeypatch.setattr(deltas, "_write", kept)
    # the batch is repeated, the compaction too, over the half-written base
    assert as_set(upserted(spark, bugs, path, target, log).select(*bugs.columns)) == expected(bugs)
    assert deltas.generation(spark, target)[0] is not None


def test_readers_keep_the_generation_they_began_with(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"))
    fold, target = (lambda r: r.groupBy("k").agg(F.sum("n").cast("int").alias("n"))), str(tmp_path / "t")
    deltas.append(rows, target, 0, "k", fold)
    deltas.compact(spark, target, rows.schema, "k", fold)
    deltas.append(rows, target, 1, "k", fold)
    began = deltas.read(spark, target, rows.schema, "k", fold)
    deltas.compact(spark, target, rows.schema, "k", fold)
    assert began.agg(F.sum("n")).first()[0] == 400
    for number in (2, 3):
        deltas.append(rows, target, number, "k", fold)
        deltas.compact(spark, target, rows.schema, "k", fold)
    assert deltas.read(spark, target, rows.schema, "k", fold).agg(F.sum("n")).first()[0] == 800
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert "base=0" not in names and "delta=0" not in names and "base=3" in names
    deltas.append(rows, target, 3, "k", fold)  # a batch that the base holds, delivered again
    assert deltas.read(spark, target, rows.schema, "k", fold).agg(F.sum("n")).first()[0] == 800


def test_weekly_counts_are_folded(spark, bugs, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    pieces(bugs, path, F.hash("feed_id"), 5)
    jobs.stream_weekly_counts(stream_of(spark, bugs, path), target, str(tmp_path / "log"), most=2).awaitTermination()
    base, left = deltas.generation(spark, target)
    assert base is not None and len(left) <= 2
    names = ["week_end", "app_version", "bug_category", "bug_count"]
    assert as_set(jobs.current_weekly_counts(spark, target).select(*names)) == as_set(aggregates.weekly_counts(bugs).select(*names))
