"""Importance resampling towards a target, with weights by bit-sliced aggregation.

A text's features are its runs of one to ``n`` consecutive words, each in the bucket that a checksum of
its bytes gives. How much more frequent a bucket is in the target than in the source is its gain, an
integer; a document's weight is the floored mean of the gains of its features. The sum behind it is
exact and comes from bit planes: bit j of all bucket counts of a document is a plane of as many bits as
there are buckets, and so is bit k of all gains, apart for gains above and below zero. Two planes are
ANDed and their common bits counted; a pair of planes counts 2 ** (j + k) times, for gains below zero
negatively.

The texts are read once: the bucket of every feature of a document is stored. Counts of the corpus are
sums by bucket, combined in every task; they and the planes of the gains are as large as the number of
buckets, whatever the corpus. Documents are drawn by weight and Gumbel noise of a hash of their key:
the highest scores are found by row numbers in the order of scores, in slices of it, so no task sorts
more than a slice, and a score that many documents share is sliced further by the key.

Words are runs of digits, letters and anything beyond ASCII, after A-Z become a-z. A null or empty text
has no features and weight 0; a null key hashes as an empty one and comes first among ties. Rows that
repeat a key are documents of their own; rows equal in key and score are interchangeable but for the
number of their features, the lesser first. Long texts are read whole. Empty documents give an empty
result, an empty target gains that only the source's counts decide. Only key and text are read, so extra
columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.order import with_row_number
from ticketloom.session import materialise

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
# Words whose bucket one worker remembers.
REMEMBERED = 400_000
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[feature] = crc32(feature) % self.buckets
        return made


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SMALL).split()


def features_of(words: list[bytes], longest: int) -> Iterator[bytes]:
    yield from words
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i:i + n])


def counted(df: DataFrame, key: str, text: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``buckets``: the bucket of every feature, four bytes each."""
    schema = T.StructType([
        df.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
        T.StructField("buckets", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            sizes, features, held = [], [], []
            for said in batch.column(1).to_pylist():
                words = words_of(said)
                own = np.fromiter(map(bucket.__getitem__, features_of(words, longest)), "<u4")
                sizes.append(len(words))
                features.append(len(own))
                held.append(np.sort(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(features, pa.int64()), pa.array(held, pa.binary())],
                names=schema.names,
            )

    return df.select(key, text).mapInArrow(run, schema)


def totals(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket, over all rows of ``counted``: one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(own, "<u4"), minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["bucket", "n"])

    made = held.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in made.collect():  # no more rows than buckets
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """The floored, scaled log of how much more frequent each bucket is in the target, counts raised by one."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit j of every value (none below zero) as row j, 64 values to a number."""
    bits = int(values.max(initial=0)).bit_length()
    rows = values[None, :] >> np.arange(bits)[:, None] & 1
    packed = np.packbits(rows.astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def signed_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the gains above zero, then of those below, and what a bit of each is worth."""
    parts = [planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))]
    worth = [sign * (1 << k) for sign, part in zip((1, -1), parts) for k in range(len(part))]
    return np.concatenate(parts), np.array(worth, np.int64)


def weighed_sum(counts: np.ndarray, gain_planes: np.ndarray, worth: np.ndarray) -> int:
    """The sum of count times gain over all buckets, by common bits of their planes."""
    total = 0
    for j, plane in enumerate(planes(counts)):
        common = np.bitwise_count(plane & gain_planes).sum(axis=1, dtype=np.int64)
        total += int(common @ worth) << j
    return total


def weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """``counted`` with ``weight``, the floored mean gain of a row's features, in place of the buckets."""
    buckets, (gain_planes, worth) = len(gain), signed_planes(gain)
    schema = T.StructType([*held.schema[:3], T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for own in batch.column(3).to_pylist():
                found = np.frombuffer(own, "<u4")
                sums = weighed_sum(np.bincount(found, minlength=buckets), gain_planes, worth) if len(found) else 0
                weights.append(sums // max(len(found), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], names=schema.names)

    return held.mapInArrow(run, schema)


def noise(key: str, seed: int = SEED, scale: int = 1000) -> Column:
    """Gumbel noise from a hash of seed and key, scaled and floored."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, key: str, eligible: Column, percent: int) -> DataFrame:
    """``rank`` of the ``percent`` hundredths of eligible rows of highest score, ties to the smaller key."""
    low, high, total = scored.filter(eligible).agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    share = (F.col(key).cast("double") - float(low or 0)) / (float(high or 0) - float(low or 0) + 1.0)
    # ascending with the score's descent, then with the key: only slices are cut by it
    place = F.coalesce(share, F.lit(0.0)) - F.col("score").cast("double")
    order = [F.col("score").desc(), F.col(key).asc_nulls_first(), F.col("n_features")]
    numbered, _ = with_row_number(scored.filter(eligible).withColumn("_place", place), "_place", order, "_row")
    drawn = F.when(F.col("_row") < percent * total // 100, (F.col("_row") + 1).cast("long"))
    columns = [F.col(c) for c in scored.columns]
    return numbered.select(*columns, drawn.alias("rank")).unionByName(
        scored.filter(~eligible).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id",
    target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if undrawn) of every row.

    The key must be a number.
    """
    held = materialise(counted(docs, key, text, longest, buckets), "features")
    aim = totals(counted(target, target_key, target_text, longest, buckets), buckets)
    judged = weighed(held, gains(totals(held, buckets), aim))
    scored = materialise(judged.withColumn("score", F.col("weight") + noise(key, seed)), "scores")
    return ranked(scored, key, F.col("n_words") >= least_words, percent)
