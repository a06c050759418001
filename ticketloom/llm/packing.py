"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A document is its token ids and an end id. Whole stretches of a sequence's length are sequences of
their own. What is left of each document is packed in pools: in descending length, every rest goes to
the sequence of lowest cost that still has room for it, where a piece of length n costs
``linear * n + quadratic * n * n`` (attention is quadratic within a document). A pool opens just as
many sequences as its tokens need; a rest that fits nowhere is cut and fills the largest gaps, so a
pool wastes less than one sequence. A pool is a bounded block of a sorted partition, so no task holds
more than a block, whatever the keys.

Null and empty texts are the end id alone. Long texts become many whole sequences. Equal keys and
repeated rows are documents of their own. An empty table gives no pieces. Only the key and the text
of the input are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.tokenize import balanced, byte_lengths, encoder

CAPACITY, END_ID = 2048, 1
# Rests in a pool: enough to fill sequences well, few enough for one block in memory.
POOL_ROWS = 4096
# Costs of a token and of a pair of tokens: 24 d^2 and 4 d operations a layer, for width d = 2048.
LINEAR, QUADRATIC = 1.0, 1 / (6 * 2048)

Piece = tuple[int, int, int, int, int]


def place_pool(
    lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> list[Piece]:
    """Pieces (row, start within the row, length, sequence, offset) of rests in descending length."""
    count = ceil(sum(lengths) / capacity)
    room, cost = np.full(count, capacity), np.zeros(count)
    pieces = []
    for row, left in enumerate(lengths):
        start = 0
        while left:
            fits = room >= left
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[at]))
            pieces.append((row, start, n, at, capacity - int(room[at])))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces


def _pieces_schema(df: DataFrame, key: str, *more: T.StructField) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    return T.StructType([df.schema[key], *longs, *more])


def tokenised(df: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row for every whole stretch of a document and one for its rest, which carries its ids."""
    schema = _pieces_schema(df, key, T.StructField("ids", T.BinaryType()))
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in balanced(byte_lengths(batch.column(1))):
                rows: list[tuple] = []
                for i, ids in enumerate(encode(texts[a:b]), a):
                    ids = np.append(ids, end_id).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        own = ids[start:start + capacity]
                        kept = own.tobytes() if with_ids else own.astype(_narrow(own)).tobytes() if len(own) < capacity else None
                        rows.append((i, start, len(own), crc32(own.tobytes()), len(ids), kept))
                columns = list(zip(*rows))
                made = [pa.array(c, pa.int64()) for c in columns[1:5]] + [pa.array(columns[5], pa.binary())]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0])), *made], names=names)

    return df.select(key, text).mapInArrow(cut, schema)


def _narrow(ids: np.ndarray) -> str:
    """Two bytes an id where they suffice."""
    return "<u2" if len(ids) and int(ids.max()) < 1 << 16 else "<u4"


def pack(
    df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True, pool_rows: int = POOL_ROWS,
) -> DataFrame:
    """Pieces with their place: sequence and offset. Every id of every document is in one piece.

    ``ids_crc32`` is the checksum of a piece's ids as little-endian unsigned 32-bit numbers;
    ``with_ids`` adds these bytes themselves.
    """
    pieces = tokenised(df, key, text, path, capacity, end_id, with_ids)
    # a character is one token at most, but for bytes of rare scripts, so this bounds the pieces of long documents
    held = df.agg(F.sum(1 + F.coalesce(F.octet_length(text), F.lit(0)).cast("long") / (3 * capacity))).first()[0] or 0
    pools = max(1, ceil(held / pool_rows))
    pool = F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(pools)).alias("_pool")
    # descending: whole sequences first, then the rests
    pooled = pieces.select(pool, "*").repartition("_pool").sortWithinPartitions(
        "_pool", F.col("length").desc(), key, "start", "ids_crc32"
    )
    extra = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    ids_field = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = _pieces_schema(df, key, *extra, *ids_field)
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool_now, number = None, 0
        block: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not block:
                return
            rows = []
            for at, start, n, sequence, offset in place_pool([r["length"] for r in block], capacity, linear, quadratic):
                row = block[at]
                ids = row["ids"]
                if n == row["length"]:
                    crc = row["ids_crc32"]
                    own = ids
                else:
                    width = len(ids) // row["length"]
                    own = np.frombuffer(ids, f"<u{width}")[start:start + n].astype("<u4").tobytes()
                    crc = crc32(own)
                place_ = ((pool_now << 32) + number + sequence, offset)
                rows.append((row[key], row["start"] + start, n, crc, row["doc_tokens"], *place_, *([own] if with_ids else [])))
            number += 1 + max(r[5] for r in rows) - ((pool_now << 32) + number)
            block.clear()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow_schema)

        arrow_schema = None
        for batch in batches:
            if arrow_schema is None:
                kinds = {"ids": pa.binary(), key: batch.schema.field(key).type}
                arrow_schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in names])
            for row in batch.to_pylist():
                if row["_pool"] != pool_now:
                    yield from close()
                    pool_now, number = row["_pool"], 0
                block.append(row)
                if len(block) == 2 * pool_rows:
                    yield from close()
        yield from close()

    return pooled.mapInArrow(place, schema)
