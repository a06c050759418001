"""Tables that grow by small batches: merge on read over a base and its deltas, and compaction.

A table is a folder. Every batch adds ``delta=<number>``: its own rows folded to what the table keeps of
them, sorted by key, so a batch writes in proportion to itself. ``base=<number>`` holds everything up to
that delta, folded, and is written by a compaction alone. Beside each folder, ``ranges`` keeps a manifest:
every file's least and greatest key and its rows. A reader takes the last complete base and the complete
deltas after it and folds them; with bounds on the key it opens only files whose range meets them.

A fold is a function from rows to rows of the same columns that may be applied to parts first: the latest
row of every key, sums by key, or nothing at all. Rows of the base whose key is in no delta need no
folding: they pass through, so a read shuffles what the deltas touch and not the history.

A folder counts once its success mark is there, which the writer sets last; a base is only ever a new
folder. Whatever dies leaves a folder that nobody reads and the next writer replaces. A batch that is
repeated writes its own delta again. A compaction leaves the generation before it in place for readers
that began with it and removes what is older.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.sources.versions import remove

# A compaction is due when the deltas hold this share of the base's bytes, or so many folders.
RATIO, MOST_DELTAS = 0.5, 100

Fold = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, path: str, kind: str, complete: bool = True) -> list[int]:
    """The numbers of the table's bases or deltas, ascending."""
    files, root = _files(spark, path)
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
    if not complete:
        return found
    return [n for n in found if files.exists(_files(spark, f"{path}/{kind}={n}/_SUCCESS")[1])]


def _bytes(spark: SparkSession, path: str) -> int:
    files, folder = _files(spark, path)
    return files.getContentSummary(folder).getLength()


def generation(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last complete base and the complete deltas after it."""
    bases = _numbers(spark, path, "base")
    base = bases[-1] if bases else None
    return base, [n for n in _numbers(spark, path, "delta") if base is None or n > base]


def _write(df: DataFrame, path: str, name: str, key: str) -> None:
    """A folder sorted by key over its files, after its manifest's place is cleared; the manifest last."""
    spark = df.sparkSession
    df.repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first()).write.mode(
        "overwrite"
    ).parquet(f"{path}/{name}")
    stored = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    ranges = stored.select(file, F.col(key).cast("string").alias("key")).groupBy("file").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.bool_or(F.col("key").isNull()).alias("nulls"),
        F.count(F.lit(1)).alias("rows"),
    )
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges/{name}")


RANGES = "file string, first string, last string, nulls boolean, rows bigint"


def _read(spark: SparkSession, path: str, name: str, schema: T.StructType, bounds: tuple[str, str] | None) -> DataFrame:
    """One folder; with bounds on a text key only those files that may hold some of it."""
    folder, reader = f"{path}/{name}", spark.read.schema(schema)
    files, manifest = _files(spark, f"{path}/ranges/{name}/_SUCCESS")
    if bounds is None or not files.exists(manifest):
        return reader.parquet(folder)
    low, high = bounds
    ranges = spark.read.schema(RANGES).parquet(f"{path}/ranges/{name}")
    # one name a file of one folder
    names = [r.file for r in ranges.filter((F.col("last") >= low) & (F.col("first") <= high)).select("file").collect()]
    return reader.parquet(*[f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, number: int, key: str, fold: Fold) -> None:
    """Add the rows of batch ``number``. A batch that the base already holds changes nothing."""
    base, _ = generation(df.sparkSession, path)
    if base is None or number > base:
        _write(fold(df), path, f"delta={number}", key)


def read(
    spark: SparkSession, path: str, schema: T.StructType, key: str, fold: Fold, bounds: tuple[str, str] | None = None,
    upto: int | None = None,
) -> DataFrame:
    """The table's rows, folded; with ``bounds`` only those whose text key lies within them.

    ``upto`` leaves out deltas of a greater number, where a base does not hold them yet.
    """
    base, deltas = generation(spark, path)
    parts = [_read(spark, path, f"delta={n}", schema, bounds) for n in deltas if upto is None or n <= upto]
    held = None if base is None else _read(spark, path, f"base={base}", schema, bounds)
    if not parts:
        made = spark.createDataFrame([], schema) if held is None else held
    else:
        fresh = parts[0]
        for part in parts[1:]:
            fresh = fresh.unionByName(part)
        if held is None:
            made = fold(fresh) if len(parts) > 1 else fresh
        else:
            touched = fresh.select(F.col(key).alias("_touched")).distinct()
            same = F.col(key).eqNullSafe(F.col("_touched"))
            made = held.join(touched, same, "left_anti").unionByName(
                fold(held.join(touched, same, "left_semi").unionByName(fresh))
            )
    return made if bounds is None else made.filter(F.col(key).between(*bounds))


def due(spark: SparkSession, path: str, ratio: float = RATIO, most: int = MOST_DELTAS) -> bool:
    """Do the deltas hold more than ``ratio`` of the base's bytes, or more than ``most`` folders?"""
    base, deltas = generation(spark, path)
    if not deltas:
        return False
    held = 0 if base is None else _bytes(spark, f"{path}/base={base}")
    return len(deltas) > most or sum(_bytes(spark, f"{path}/delta={n}") for n in deltas) > ratio * held


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, fold: Fold) -> None:
    """Fold the base and all deltas into a new base; then remove what only older readers could need."""
    before, deltas = generation(spark, path)
    if not deltas:
        return
    _write(read(spark, path, schema, key, fold, upto=deltas[-1]), path, f"base={deltas[-1]}", key)
    # the generation just read stays until the next compaction
    stale = [f"base={n}" for n in _numbers(spark, path, "base", complete=False) if n < (before if before is not None else -1)]
    if before is not None:
        stale += [f"delta={n}" for n in _numbers(spark, path, "delta", complete=False) if n <= before]
    for name in stale:
        remove(spark, f"{path}/{name}")
        remove(spark, f"{path}/ranges/{name}")
