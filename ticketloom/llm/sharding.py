"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row's number x, its place in the order of the key, is taken as a pair of digits to base
``ceil(sqrt(N))``. Rounds of a Feistel network permute these pairs; a value that falls outside the N
rows is permuted again until it falls inside (cycle walking), so the result is a permutation of
0 .. N-1. Shard and slot are the remainder and the quotient of the permuted number, which anyone can
compute again from the row's number and the seed, without the other rows.

Only DataFrame functions are used. Nulls: a null key comes first in the order, a null text has no
bytes. Rows that repeat a key are told apart by size and checksum; rows equal in these too are
interchangeable. An empty table gives an empty result. Columns of the input are kept only where the
caller asks, and never clash, because the result is made of fresh columns.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.order import with_row_number

PRIME = 2_147_483_647
ROUNDS = 6
WALK = 40


def base_of(total: int) -> int:
    """The smallest base whose square holds ``total`` numbers."""
    return isqrt(max(total, 1) - 1) + 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A factor and an addend for every round, by a linear congruential sequence from the seed."""
    keys, state = [], seed % PRIME
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state * 48_271 + 11) % PRIME
            pair.append(state or 1)
        keys.append(tuple(pair))
    return keys


def permute_once(x: int, base: int, keys: list[tuple[int, int]]) -> int:
    """One pass of the network in plain Python, for tests and for readers of the shards."""
    left, right = divmod(x, base)
    for factor, addend in keys:
        mixed = (right % PRIME * factor + addend) % PRIME
        left, right = right, (left + (mixed * mixed + factor) % PRIME) % base
    return left * base + right


def _pass(x: Column, base: int, keys: list[tuple[int, int]]) -> Column:
    rounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in keys])

    def one(pair, key):
        mixed = F.array((pair.right % PRIME * key.a + key.b) % PRIME)
        grown = F.transform(mixed, lambda m: (m * m + key.a) % PRIME)[0]
        return F.struct(pair.right.alias("left"), ((pair.left + grown) % base).alias("right"))

    start = F.struct(F.call_function("div", x, F.lit(base)).alias("left"), (x % base).alias("right"))
    return F.aggregate(rounds, start, one, lambda pair: pair.left * base + pair.right)


def permuted(x: Column, total: int, seed: int) -> Column:
    """The place of row number ``x`` among ``total`` rows after the shuffle.

    At most ``base ** 2 - total`` numbers lie outside, under 2 of every ``base``; a walk leaves them
    after WALK steps with a chance below 10 ** -40 for large tables and always for small ones. If one
    ever did not, the query fails rather than give a wrong place.
    """
    base = base_of(total)
    keys = round_keys(seed)
    steps = min(base * base - total, WALK)
    place = _pass(x, base, keys)
    if steps:
        walk = lambda p, _: F.when(p < total, p).otherwise(_pass(p, base, keys))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), place, walk)
    unended = F.raise_error(F.lit("cycle walk did not end; choose another seed")).cast("long")
    return F.transform(F.array(place), lambda p: F.when(p < total, p).otherwise(unended))[0]


def shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", count: int = 8, seed: int = 20_240_229
) -> DataFrame:
    """``key``, size in bytes plus one, checksum, shard and slot of every row; shards differ by one row."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = df.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    numbered, total = with_row_number(sized, key, ["size", "text_crc32"], "_number")
    placed = numbered.withColumn("_place", permuted(F.col("_number"), total, seed))
    return placed.select(
        key, "size", "text_crc32",
        (F.col("_place") % count).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), F.lit(count)).alias("slot"),
    )
