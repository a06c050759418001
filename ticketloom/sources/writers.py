"""Sinks. All write one file per partition; none passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Replace a table."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes inside texts are doubled, times keep their microseconds."""
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"header": True, "escape": '"', "timestampNTZFormat": exact, "timestampFormat": exact + "XXX"}
    df.write.mode("overwrite").options(**options).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One text column, one line a row: the syslog export."""
    df.write.mode("overwrite").text(path)


def replace_unless_empty(df: DataFrame, path: str) -> bool:
    """Overwrite a parquet folder, but never with nothing: a failed fetch must not erase history."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
