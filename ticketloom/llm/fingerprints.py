"""Document fingerprints: one-permutation MinHash, filled by optimal densification, packed low bits.

Every run of five words is hashed once. The top byte of a hash is its bin, of which there are 256;
the least hash of a bin stands for it. An empty bin takes over the value of a filled one, found by
probing bins in an order that depends on the empty bin alone, so that two documents probe alike. Of
every value the low eight bits are kept, four bins in a number. Two fingerprints agree in a bin with
the likeness J of the documents, or by chance in one of 256, hence the correction
``(m / 256 - 1 / 256) / (1 - 1 / 256)`` of the m bins that agree.

Only DataFrame functions are used, and all of a text's work happens in its row: no shuffle. Words are
runs of anything but the six ASCII white-space characters. A null text counts as empty; an empty text
has an empty fingerprint, of likeness 1 to another such and 0 to any other; a text of fewer than five
words is one shingle. Long texts are read whole. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.order import default_slices, slice_bounds, slice_of

WORDS = 5
BINS = 256
LANES = 4
PROBES = 12
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` on a value that is computed once, not once for every use."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A hash for every run of ``words`` words, one for a shorter text, none for an empty one."""

    def runs(h: Column) -> Column:
        n = F.size(h)
        run = lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)])
        return (
            F.when(n >= words, F.transform(F.slice(h, F.lit(1), F.greatest(n - (words - 1), F.lit(0))), run))
            .when(n > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), runs)


def _densified(own: Column) -> Column:
    """Fill nulls: probe bins in the empty bin's own order, past PROBES by its order of all filled ones."""

    def fill(value: Column, i: Column) -> Column:
        probes = [F.get(own, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS))) for t in range(PROBES)]
        ranked = F.transform(
            own, lambda v, j: F.when(v.isNotNull(), F.struct(F.xxhash64(j, i).alias("rank"), v.alias("value")))
        )
        return F.coalesce(value, *probes, F.array_min(ranked)["value"])

    return F.transform(own, fill)


def fingerprint(text: Column) -> Column:
    """64 numbers of four bins each; an empty array for an empty text."""
    ends = [((b - 128) << 56) + (1 << 56) - 1 for b in range(BINS)]  # the last value of every bin
    marks = F.array(*map(F.lit, ends))

    def bins(ordered: Column) -> Column:
        top = lambda x: F.shiftright(x, 56)
        least = F.filter(ordered, lambda x, i: (i == 0) | (top(x) != top(F.get(ordered, i - 1))))
        own = F.transform(least, lambda x, i: F.when(x != F.get(marks, i), x.bitwiseAND(F.lit(255))))
        return let(let(own, _densified), pack)

    def pack(values: Column) -> Column:
        def lane(k: Column) -> Column:
            made = F.get(values, k * LANES)
            for j in range(1, LANES):
                made = made + F.shiftleft(F.get(values, k * LANES + j), 8 * j)
            return made

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lane)

    def whole(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
            let(F.sort_array(F.concat(hashes, marks)), bins)
        )

    return let(shingle_hashes(text), whole)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 2 * LANES, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two documents from their packed fingerprints, between 0 and 1."""
    sevens = F.lit(0x7F7F7F7F).cast("long")
    ones = F.lit(0xFFFFFFFF).cast("long")

    def equal_bins(x: Column, y: Column) -> Column:
        # a byte of d is zero exactly if adding 0x7F to its low seven bits leaves its top bit unset
        def zeros(d: Column) -> Column:
            carried = (d.bitwiseAND(sevens) + sevens).bitwiseOR(d).bitwiseOR(sevens)
            return F.bit_count(carried.bitwiseXOR(ones)).cast("int")

        return let(x.bitwiseXOR(y), zeros)

    matches = F.aggregate(F.zip_with(a, b, equal_bins), F.lit(0), lambda total, n: total + n)
    chance = 1.0 / 256
    corrected = (matches / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))
    )


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<c>``: the value of the next row in the order of ``key``; the last row's is the first.

    Rows go to slices of the key's range, by one shuffle. The first row of a slice goes to the slice
    before too, as its end, so that no task sees more than a slice and its neighbour's first row.
    Nulls come first; equal keys follow each other in the order of the first of ``columns``.
    """
    bounds = slice_bounds(df, key, default_slices(df))
    order = [F.col(key).asc_nulls_first(), F.col(columns[0])]
    at = slice_of(key, bounds)
    starts = F.lit(False)
    if bounds:
        starts = F.coalesce(F.get(F.array(*map(F.lit, bounds)), at - 1) == F.col(key), F.lit(False))
    place = lambda s, guest: F.struct(s.alias("slice"), F.lit(guest).alias("guest"))
    own, end = place(at, 0), place(at - 1, 1)
    placed = df.withColumn("_at", F.explode(F.when(starts & (at > 0), F.array(own, end)).otherwise(F.array(own))))
    first = df.orderBy(*order).limit(1).withColumn("_at", place(F.lit(len(bounds)), 2))
    within = Window.partitionBy("_at.slice").orderBy("_at.guest", *order)
    led = placed.unionByName(first).withColumns({f"next_{c}": F.lead(c).over(within) for c in columns})
    return led.filter("_at.guest = 0").drop("_at")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the start of the following text."""
    n = F.char_length(text)
    quarter = F.call_function("div", n, F.lit(4)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed fingerprint of every text, under ``fingerprint``, with key and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key), body.alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
