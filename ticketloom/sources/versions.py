"""Tables that are replaced as a whole while they are read: versioned folders, the last complete one counts.

A version is a folder ``v=<number>``. It is written elsewhere and put into place by a rename that fails
where its number is taken, so two writers never share a folder, and a version is complete from its first
moment (the success mark is still asked for, for stores whose rename copies). ``write_next`` then takes
the next number; ``update``, which makes the new version out of the last one, begins again from the one
that came in between, so no writer's change is lost. A run that dies leaves a staged folder that nobody
reads; it goes when it is a day old.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STALE_MS = 24 * 3600 * 1000


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Number and completeness of every version, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [(n, files.exists(hadoop(f"{path}/v={n:06d}/_SUCCESS"))) for n in numbers]


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last complete version."""
    complete = [n for n, done in _versions(spark, path) if done]
    return f"{path}/v={complete[-1]:06d}" if complete else None


def read_current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last complete version; empty if there is none."""
    folder = current(spark, path)
    return spark.read.schema(schema).parquet(folder) if folder else spark.createDataFrame([], schema)


def _put(spark: SparkSession, staged: str, folder: str) -> bool:
    """Rename ``staged`` to ``folder``; False, and nothing done, where ``folder`` exists."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = fs.Path(folder)
    if target.getFileSystem(conf).exists(target):
        return False
    files = fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    try:
        files.rename(fs.Path(staged), target, spark._sc._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError:
        if not target.getFileSystem(conf).exists(target):
            raise
        return False
    return True


def _stage(df: DataFrame, path: str) -> str:
    staged = f"{path}/_staged-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(staged)
    return staged


def _clean(spark: SparkSession, path: str, number: int, keep: int) -> None:
    """Remove all before version ``number`` but the last ``keep`` complete ones, and staged folders of dead writers."""
    versions = _versions(spark, path)
    complete = [n for n, done in versions if done]
    for n, done in versions:
        if n < number and (not done or n not in complete[-keep:]):
            remove(spark, f"{path}/v={n:06d}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for entry in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):
        if entry.getPath().getName().startswith("_staged-") and now - entry.getModificationTime() > STALE_MS:
            remove(spark, entry.getPath().toString())


def write_next(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write a new version and remove all but the last ``keep`` complete ones. Returns its folder.

    ``df`` may read the version before. Of two writers at once both versions stand, one after the other.
    """
    spark = df.sparkSession
    staged = _stage(df, path)
    while True:
        number = max([n for n, _ in _versions(spark, path)], default=0) + 1
        folder = f"{path}/v={number:06d}"
        if _put(spark, staged, folder):
            _clean(spark, path, number, keep)
            return folder


def update(
    spark: SparkSession, path: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame], keep: int = 2,
) -> str:
    """Replace the last version by ``change`` of it. Returns the new folder.

    If another version appears meanwhile, ``change`` is applied to that one. It may run several times, and
    on a version that already holds its effect.
    """
    while True:
        known = _versions(spark, path)
        number = max([n for n, _ in known], default=0) + 1
        folder = f"{path}/v={number:06d}"
        complete = [n for n, done in known if done]
        last = f"{path}/v={complete[-1]:06d}" if complete else None
        before = spark.read.schema(schema).parquet(last) if last else spark.createDataFrame([], schema)
        staged = _stage(change(before), path)
        if _put(spark, staged, folder):
            _clean(spark, path, number, keep)
            return folder
        remove(spark, staged)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
