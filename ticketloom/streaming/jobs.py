"""The daily reruns as incremental jobs. Each gives the same result as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom.operators.aggregates import weekly_counts
from ticketloom.operators.ingest import upsert_latest
from ticketloom.operators.state import DIGEST_COLUMNS, new_tickets
from ticketloom.sources import deltas
from ticketloom.sources.readers import path_exists
from ticketloom.sources.versions import remove


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stream_upsert(
    stream: DataFrame, target: str, checkpoint: str, key: str = "review_id",
    tiebreak: list[str] | None = None, buckets: int = 64, splits: int = 4,
) -> StreamingQuery:
    """Keep the latest review per key in a parquet folder partitioned by key bucket.

    The result is that of one upsert of all rows so far, whichever batch brought them: rows equal in
    date go by ``tiebreak`` (or by all other columns), not by arrival. A micro-batch is stored once and
    rewrites the buckets it touches, each in ``splits`` files; choose ``buckets`` so that a bucket of
    the whole history is a few tasks' work. The merged buckets are first written to a staging folder
    named by the batch, so that a batch that failed while it replaced them is finished from there;
    the folders of earlier batches are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        arrived, staged = (f"{checkpoint}/{kind}/batch={batch_id}" for kind in ("arrived", "staged"))
        for kind in ("arrived", "staged"):
            remove(session, f"{checkpoint}/{kind}/batch={batch_id - 1}")
        if not path_exists(session, f"{staged}/_SUCCESS"):
            rows = batch.withColumn("bucket", _bucket(key, buckets))
            rows.write.mode("overwrite").parquet(arrived)
            incoming = session.read.schema(rows.schema).parquet(arrived)
            if path_exists(session, target):
                touched = incoming.select("bucket").distinct()
                existing = session.read.schema(rows.schema).parquet(target).join(touched, "bucket", "left_semi")
            else:
                existing = incoming.limit(0)
            merged = upsert_latest(existing, incoming, key, tiebreak, incoming_wins=False)
            split = F.pmod(F.xxhash64(F.lit(1), key), F.lit(splits))
            merged.repartition("bucket", split).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        writer = session.read.parquet(staged).write.mode("overwrite").partitionBy("bucket")
        writer.option("partitionOverwriteMode", "dynamic").parquet(target)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{checkpoint}/log")
        .trigger(availableNow=True)
        .start()
    )


def _latest(key: str, tiebreak: list[str] | None):
    return lambda rows: upsert_latest(rows.limit(0), rows, key, tiebreak, incoming_wins=False)


def stream_upsert_deltas(
    stream: DataFrame, target: str, checkpoint: str, key: str = "review_id", tiebreak: list[str] | None = None,
    ratio: float = deltas.RATIO, most: int = deltas.MOST_DELTAS,
) -> StreamingQuery:
    """Keep the latest review per key as a base and deltas, which ``current_reviews`` merges when read.

    The result is that of one upsert of all rows so far, as with ``stream_upsert``; but a micro-batch
    writes only its own rows, one a key. When the deltas outgrow ``ratio`` of the base, or are more than
    ``most``, the batch that notices folds them into a new base; ``ratio=inf`` leaves that to a job of
    its own, which calls ``deltas.compact``.
    """
    fold, schema = _latest(key, tiebreak), stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        deltas.append(batch, target, batch_id, key, fold)
        if batch_id and deltas.due(batch.sparkSession, target, ratio, most):
            deltas.compact(batch.sparkSession, target, schema, key, fold)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_reviews(
    spark: SparkSession, target: str, schema, key: str = "review_id", tiebreak: list[str] | None = None,
    bounds: tuple[str, str] | None = None,
) -> DataFrame:
    """The latest review per key of ``stream_upsert_deltas``; with ``bounds`` only keys between them."""
    return deltas.read(spark, target, schema, key, _latest(key, tiebreak), bounds)


def stream_new_tickets(
    tickets: DataFrame, sent: DataFrame, target: str, checkpoint: str, delay: str | None = "7 days"
) -> StreamingQuery:
    """Append each ticket whose key was neither sent nor emitted before, once.

    Keys repeated within ``delay`` of their arrival are dropped by the stream's state, whose size
    that bounds; older repeats meet the emitted table, which every batch reads. The watermark follows the
    arrival time, so no ticket is too late. Each batch overwrites its own folder, so a repeated batch
    changes nothing.

    With ``delay=None`` the state keeps every key and no batch reads what others emitted: its cost is
    that of its own keys. The checkpoint is then the only memory of the stream; keep it with the target,
    and the state in the store on disk that Spark has for large state.
    """
    if delay is None:
        once = tickets.dropDuplicates(["ticket_key"])
    else:
        arrived = tickets.withColumn("_arrived", F.current_timestamp())
        once = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["ticket_key"])

    def emit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = sent.select("ticket_key", "ticket_id")
        if delay is not None and path_exists(session, target):
            emitted = session.read.schema("ticket_key string, TicketID string, batch_id int").parquet(target)
            before = emitted.filter(F.col("batch_id") < batch_id)
            known = known.unionByName(before.select("ticket_key", F.col("TicketID").alias("ticket_id")))
        fresh = new_tickets(batch, known).select(*DIGEST_COLUMNS)
        fresh.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        once.writeStream.foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


WEEKLY_COUNTS = "week_end date, app_version string, bug_category string, bug_count bigint"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("week_end", "app_version", "bug_category").agg(F.sum("bug_count").alias("bug_count"))


def stream_weekly_counts(
    stream: DataFrame, target: str, checkpoint: str, ratio: float = 4.0, most: int = deltas.MOST_DELTAS
) -> StreamingQuery:
    """Counts of each micro-batch per week, version and category, a delta per batch.

    The stored counts are the state, so nothing waits for a watermark: a late row is counted when it
    comes, and a date in the future holds nothing back. A repeated batch overwrites its own delta. Deltas
    that outgrow the base are folded into it, so what a reader sums does not grow with the batches.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        deltas.append(weekly_counts(batch), target, batch_id, "week_end", lambda rows: rows)
        if batch_id and deltas.due(session, target, ratio, most):
            deltas.compact(session, target, session.createDataFrame([], WEEKLY_COUNTS).schema, "week_end", _summed)

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_weekly_counts(spark: SparkSession, target: str) -> DataFrame:
    """What the stream has counted so far: the base's and all later batches' counts, summed."""
    return deltas.read(spark, target, spark.createDataFrame([], WEEKLY_COUNTS).schema, "week_end", _summed)
