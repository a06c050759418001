"""State kept between runs: attended tickets, sent tickets, the digest of new ones.

Everything here goes by ``ticket_key``, the whole hash. ``TicketID`` is its first eight digits and
only shown: different tickets may share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators.tickets import newest_first
from ticketloom.session import materialise

DIGEST_COLUMNS = ["ticket_key", "TicketID", "bug_category", "app_version", "review_date", "review_description"]


def attended_report(attended: DataFrame, tickets: DataFrame) -> DataFrame:
    """Attended rows with their ticket details, newest first; unknown keys keep null details.

    The tickets are gone through once: those asked for are stored. A left outer join could not split
    a key that many rows share, so the matched rows come from an inner join, and the unmatched ones
    from an anti join against the keys found.
    """
    asked = attended.select("ticket_key").dropna().distinct()
    details = tickets.drop("TicketID")
    found = materialise(details.join(asked, "ticket_key", "left_semi"), "asked-tickets")
    matched = attended.join(found, "ticket_key")
    unmatched = attended.join(found.select("ticket_key").distinct(), "ticket_key", "left_anti")
    report = matched.unionByName(unmatched, allowMissingColumns=True)
    return report.orderBy(F.col("attended_at").desc_nulls_last(), "TicketID", "ticket_key")


def mark_attended(attended: DataFrame, wanted: DataFrame, at) -> DataFrame:
    """Append each ticket (``ticket_key``, ``TicketID``) not yet attended, once, with the time ``at``."""
    keyed = wanted.select("ticket_key", "TicketID").dropna(subset=["ticket_key"]).dropDuplicates(["ticket_key"])
    fresh = keyed.join(attended.dropna(subset=["ticket_key"]), "ticket_key", "left_anti")
    return attended.unionByName(fresh.withColumn("attended_at", F.lit(at).cast("timestamp_ntz")))


def sent_keys(sent: DataFrame) -> DataFrame:
    """Distinct trimmed non-blank keys, each with its id."""
    trimmed = sent.select(*[X.strip(F.col(c)).alias(c) for c in ("ticket_key", "ticket_id")])
    return trimmed.filter("ticket_key <> ''").groupBy("ticket_key").agg(F.min("ticket_id").alias("ticket_id"))


def adopt_sent(old: DataFrame, tickets: DataFrame) -> DataFrame:
    """A table of sent ids from before there were keys: every ticket that shows one of them counts as sent."""
    ids = old.select(X.strip(F.col("ticket_id")).alias("TicketID")).filter("TicketID <> ''").distinct()
    keyed = tickets.select("ticket_key", "TicketID").join(ids, "TicketID").distinct()
    return keyed.select("ticket_key", F.col("TicketID").alias("ticket_id"))


def digest_mode(sent: DataFrame) -> DataFrame:
    """One row: is this a first run? True with no id, or with only old all-digit ids."""
    ids = X.strip(F.col("ticket_id"))
    legacy = F.substring(ids, 5, 1 << 30).rlike("^[0-9]+$")
    kept = sent.filter(ids != "")
    return kept.agg(
        F.count_distinct(ids).alias("sent_ids"),
        F.coalesce(F.bool_and(legacy), F.lit(True)).alias("first_run"),
    )


def new_tickets(tickets: DataFrame, sent: DataFrame) -> DataFrame:
    """Tickets whose key is not in ``sent``. Null keys in ``sent`` match nothing and are dropped."""
    return tickets.join(sent_keys(sent).select("ticket_key"), "ticket_key", "left_anti").select(*DIGEST_COLUMNS)


def latest_tickets(tickets: DataFrame, first_n: int = 10) -> DataFrame:
    return newest_first(tickets).select(*DIGEST_COLUMNS).limit(first_n)


def next_sent(sent: DataFrame, rows: DataFrame) -> DataFrame:
    """Sent keys and ids together with those of ``rows``, distinct and sorted."""
    more = rows.select("ticket_key", F.col("TicketID").alias("ticket_id"))
    return sent_keys(sent.select("ticket_key", "ticket_id").union(more)).orderBy("ticket_id", "ticket_key")


def digest(tickets: DataFrame, sent: DataFrame, first_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows to send and the sent table to store once they are out.

    The first run sends only the newest tickets but counts all of them as sent.
    """
    if digest_mode(sent).first().first_run:
        return latest_tickets(tickets, first_n), next_sent(sent.limit(0), tickets)
    rows = new_tickets(tickets, sent)
    return newest_first(rows), next_sent(sent, rows)
