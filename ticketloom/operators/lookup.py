"""Small dimension tables, and the size check in front of every use of one as a literal."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketloom import fixed_values as V
from ticketloom import schemas as S

# Up to this many rows a lookup table is inlined into the expression; a larger one is joined.
INLINE_ROWS = 1000


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A local relation: Catalyst knows its size and decides itself whether to broadcast it."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def unique(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row per non-null key: that of the lowest ``pos`` where the table has one, else of the least values.

    Every dimension table goes through here, so that a key listed twice means the same to a lookup
    inside the row and to a join.
    """
    rows = df.filter(F.col(key).isNotNull())
    if not values:
        return rows.select(key).distinct()
    order = F.struct(*[F.col(c) for c in ("pos", *values) if c in df.columns])
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return first.select(key, *[F.col(f"_first.{v}").alias(v) for v in values])


def bounded_rows(df: DataFrame, limit: int = INLINE_ROWS) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``limit``, else None. Never fetches more."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def severity_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, V.SEVERITY, S.SEVERITY_MAP)


def taxonomy_rules(spark: SparkSession, compat: bool = False) -> DataFrame:
    """The default taxonomy. ``compat`` leaves out the two rules that a missing comma once hid."""
    pairs = [(cat, kw) for cat, kws in V.TAXONOMY.items() for kw in kws]
    if compat:
        pairs = [(cat, kw) for cat, kw in pairs if kw not in ("log account", "password")]
    return small_table(spark, [(i, *p) for i, p in enumerate(pairs)], S.TAXONOMY_RULES)


def stopword_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(w,) for w in V.STOPWORDS], S.STOPWORDS)


def lemma_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(V.LEMMAS.items()), S.LEMMAS)


def lexicon_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(V.LEXICON.items()), S.LEXICON)


def distinct_array(df: DataFrame, col: str):
    """Sorted distinct non-null values of a bounded dimension column, as a scalar subquery."""
    return df.agg(F.array_sort(F.collect_set(col))).scalar()
