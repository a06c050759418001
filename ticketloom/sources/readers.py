"""Reading: files if they are there, else a table, else an error or an empty typed frame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.operators.ingest import require_columns
from ticketloom.schemas import SENT_TICKETS
from ticketloom.session import materialise


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist on the file system that its scheme names?"""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header; quoted texts may hold doubled quotes and, if ``multi_line``, line breaks.

    Columns are matched by name, whatever their order; others are left out, missing ones are an
    error. All files below ``path`` must have the header of the first: one that differs is an error,
    not rows in the wrong columns. A value that does not fit its type is null; words like ``null`` and
    ``nan`` stay text. A file with line breaks in its texts is one task here: read a large one by
    ``read_csv_blocks``, or say ``multi_line=False`` where no text has any.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "enforceSchema": False}
    header = spark.read.options(**options).csv(path).columns
    known = {field.name: field for field in schema}
    actual = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    df = spark.read.options(**options).schema(actual).csv(path)
    return require_columns(df, schema.names).select(*schema.names)


# Up to this many blocks their parities go to every task; more are joined, at the price of a shuffle of the lines.
BROADCAST_BLOCKS = 200_000


def read_csv_blocks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_csv``, with line breaks in quoted texts, but each file is read by as many tasks as it has blocks.

    Spark cuts files into blocks of whole lines. A first pass counts the quotes of every block; the sum
    of those before a block says whether it begins inside a quoted text. A second pass then puts lines
    together to records; what a record has on both sides of a border goes by the number of the record and is
    joined there, so no task holds more than a block, or a record, at a time.

    Texts with quotes, commas or line breaks must be quoted and their quotes doubled, as ``write_csv``
    does; a file whose quotes are not even in number is an error. Lines end in LF or CRLF.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}
    header = spark.read.options(**options).csv(path).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    quotes = F.sum(F.length(F.regexp_replace("value", '[^"]', ""))).alias("quotes")
    # without the order of lines: only sums
    counted = materialise(lines.groupBy("file", "block").agg(quotes), "csv-blocks")
    odd = counted.groupBy("file").agg(F.sum("quotes").alias("n")).filter("n % 2 = 1").select("file").take(1)
    if odd:
        raise ValueError(f"an odd number of quotes in {odd[0].file}")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    placed = lines.withColumn("line", F.monotonically_increasing_id())
    if counted.count() <= BROADCAST_BLOCKS:
        known = placed.join(F.broadcast(starts), ["file", "block"])  # keeps the order of the scan
    else:
        known = placed.join(starts, ["file", "block"]).repartition("file", "block")
        known = known.sortWithinPartitions("file", "block", "line")
    parts = materialise(known.select("file", "block", "inside", "value").mapInArrow(_records, RECORD_PARTS), "csv-records")
    whole = parts.filter("kind = 'whole'").select("file", "block", "number", "record")
    # a record over a border: the last part of one block, blocks all inside it, and the first part of another
    order = Window.partitionBy("file").orderBy("block", "number")
    split = parts.filter("kind <> 'whole'").withColumn("own", F.sum((F.col("kind") == "begins").cast("int")).over(order))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "record"))), lambda x: x.record)
    joined = split.groupBy("file", "own").agg(
        F.min(F.struct("block", "number")).alias("at"), F.array_join(pieces, "\n").alias("record")
    ).select("file", F.col("at.block").alias("block"), F.col("at.number").alias("number"), "record")
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    first = (F.col("block") == 0) & (F.col("number") == 0)
    known_types = {field.name: field for field in schema}
    actual = T.StructType([known_types.get(c, T.StructField(c, T.StringType())) for c in header])
    parse = lambda column, types: F.from_csv(column, types, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    # the first record of a file must be the header of the first file
    texts = ", ".join(f"`{c}` string" for c in header)
    wanted = F.array(*map(F.lit, header))
    named = parse(F.col("record"), texts)
    same = F.array(*[named[c] for c in header]) == wanted
    wrong = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
    kept = F.when(first, F.when(same, F.lit(False)).otherwise(wrong)).otherwise(F.col("record") != "")
    rows = records.filter(kept).select(parse(F.col("record"), _ddl(actual)).alias("row")).select("row.*")
    return require_columns(rows, schema.names).select(*schema.names)


RECORD_PARTS = "file string, block long, number long, kind string, record string"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order to records: whole ones, and the parts that begin, go on or end over a block's border."""
    now, inside, number, held, began = None, False, 0, [], False

    def rest() -> list[tuple]:
        if not held:
            return []
        return [(*now, number, "begins" if began else "goes on", "\n".join(held))]

    for batch in batches:
        out: list[tuple] = []
        for file, block, starts_inside, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != now:
                out += rest()
                now, inside, number, held, began = (file, block), starts_inside, 0, [], not starts_inside
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                out.append((*now, number, "whole" if began else "goes on", "\n".join(held)))
                number, held, began = number + 1, [], True
        yield _parts(out)
    yield _parts(rest())


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "number", "kind", "record"])


def read_source(
    spark: SparkSession,
    path: str | None = None,
    table: str | None = None,
    schema: T.StructType | None = None,
    empty_if_missing: bool = False,
) -> DataFrame:
    """``path`` (``.csv`` files, else parquet) before ``table``.

    With neither there: an empty frame of ``schema`` if asked for, else ``FileNotFoundError``.
    """
    if path and path_exists(spark, path):
        if path.rstrip("/").endswith(".csv"):
            return read_csv(spark, path, schema)
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if table and table_exists(spark, table):
        return spark.table(table)
    if empty_if_missing:
        return spark.createDataFrame([], schema)
    raise FileNotFoundError(f"neither a file {path} nor a table {table} to read")


def read_sent(spark: SparkSession, path: str | None = None, table: str | None = None) -> DataFrame:
    """The sent keys and ids; empty when nothing is stored or what is stored lacks the columns."""
    stored = read_source(spark, path, table, empty_if_missing=True, schema=SENT_TICKETS)
    known = set(SENT_TICKETS.names) <= set(stored.columns)
    return stored if known else spark.createDataFrame([], SENT_TICKETS)
