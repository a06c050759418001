"""Bug tickets: prediction flags, ids, ordering, filters, syslog lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom.functions import text as X
from ticketloom.operators.taxonomy import with_severity


def bugs_only(df: DataFrame) -> DataFrame:
    return df.filter("is_bug_report = 1")


def feedback_only(df: DataFrame) -> DataFrame:
    return df.filter("is_bug_report = 0")


def above(df: DataFrame, confidence: float = V.HIGH_CONFIDENCE) -> DataFrame:
    return df.filter(F.col("bug_confidence") > confidence)


def by_level(tickets: DataFrame, levels: list[str]) -> DataFrame:
    return tickets.filter(F.col("syslog_level").isin(levels))


def by_version_category(bugs: DataFrame, versions: list[str], categories: list[str]) -> DataFrame:
    """A null version matches no selection. Versions compare without surrounding white space."""
    wanted = X.strip(F.col("app_version")).isin(versions)
    return bugs.filter(wanted & F.col("bug_category").isin(categories))


def by_date(df: DataFrame, low, high, col: str = "review_date") -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(col).between(F.lit(low), F.lit(high)))


def prioritize(predictions: DataFrame, tiebreak: str = "review_id") -> DataFrame:
    """Bugs, most confident first."""
    return bugs_only(predictions).orderBy(F.col("bug_confidence").desc(), tiebreak)


def ticket_key(text: Column, date: Column, version: Column) -> Column:
    """The whole hash of text, date and version, 40 hex digits: what joins and stored state go by."""
    base = F.concat_ws("_", X.missing_as_nan(text), X.missing_as_nan(date), X.missing_as_nan(version))
    return F.upper(F.sha1(base))


def shown_id(key: Column, digits: int = 8) -> Column:
    """``BUG-`` and the first digits of the key, for people. Near 77,000 tickets two are likely to share one."""
    return F.concat(F.lit("BUG-"), F.substring(key, 1, digits))


def with_ticket_id(df: DataFrame) -> DataFrame:
    """Add ``ticket_key`` and ``TicketID``."""
    cols = [F.col(c) for c in ("review_description", "review_date", "app_version")]
    return df.withColumn("ticket_key", ticket_key(*cols)).withColumn("TicketID", shown_id(F.col("ticket_key")))


def tickets(bugs: DataFrame, severity: DataFrame) -> DataFrame:
    """Categorised bugs as tickets, without an order (see ``newest_first``)."""
    made = with_severity(with_ticket_id(bugs), severity)
    return made.select(
        "ticket_key",
        "TicketID",
        F.col("review_date").alias("Timestamp"),
        "syslog_level",
        "severity_code",
        "bug_category",
        "app_version",
        "review_date",
        "review_description",
    )


def newest_first(tickets: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """Newest first, then by id and key.

    Tickets of one key are equal in text, date and version. If very many may share one, keep a
    column that tells them apart, such as ``review_id``, and name it as ``tiebreak``: the copies
    then spread over tasks. A row number would not do, since a repeated task may number rows anew.
    """
    more = [tiebreak] if tiebreak else []
    return tickets.orderBy(F.col("review_date").desc_nulls_last(), "TicketID", "ticket_key", *more)


def syslog_lines(tickets: DataFrame) -> DataFrame:
    """One text line per ticket, in column ``value`` as the text sink wants it."""
    day = F.coalesce(F.date_format("review_date", "yyyy-MM-dd"), F.lit("N/A"))
    return tickets.select(
        F.concat(
            F.lit("<"), F.col("severity_code").cast("string"), F.lit("> ["), F.col("TicketID"),
            F.lit("] ("), F.upper("syslog_level"), F.lit(") "), F.col("bug_category"),
            F.lit(" in v"), X.missing_as_nan(F.col("app_version")), F.lit(" on "), day,
            F.lit(": "), X.missing_as_nan(F.col("review_description")),
        ).alias("value")
    )
