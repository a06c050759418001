"""Substring dedup: every word that lies in a passage an earlier document holds goes.

A window is a run of 13 words. Its minimiser is the least hash of the runs of five words within it,
so equal windows have equal minimisers. Consecutive windows of one minimiser form a super-k-mer, which
travels to the minimiser's bucket as one packed string instead of as many windows. In a bucket the
windows are sorted, and the least document of each is known exactly; windows of later documents are
repeats.

Most minimisers occur in one document only, and no window of theirs can repeat: they are counted first,
as numbers, and only super-k-mers whose minimiser occurs in several rows travel. A minimiser of very many
rows (a line or passage that a great share of the corpus holds) has no bucket of its own: its windows
are keyed by their own 128-bit hash, of which the least document is an aggregate, combined before the
shuffle, and met in a join whose skewed keys adaptive execution splits. Equal super-k-mers of such a
minimiser are one: each different one is taken apart into windows once, whatever the number of its rows,
and gives every row that holds it the least documents of its windows. No task then holds the windows of
more than a bounded number of rows, and nothing is left out.

A row whose whole text a row of a lesser key has too is a repeat from end to end; it is set aside at the
start and its windows do not travel.

Words are runs of anything but the six ASCII white-space characters, unchanged. A null text has no
words; null keys count as the least. Rows of equal key do not remove each other's words. An empty table
gives an empty result. Long texts are read whole. Columns whose names begin with an underscore are
working columns; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.hashing import mix, run_hashes, seeded, word_hashes

WINDOW, MINIMISER = 13, 5
# A minimiser of more rows than this is handled window by window.
HOT_ROWS = 2000
LEAST = -(1 << 63)
SLICE = 500
RESULTS = {"kept_text": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64()}
TRIMMED = {"trimmed_text": pa.string()}
_BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
# Hot super-k-mers whose hashes one task keeps.
REMEMBERED_KMERS = 50_000


PLACES = "W_key long, _row long, first long, windows long"
PACKED = [
    ("minimiser", pa.int64()), ("packed", pa.binary()), ("_key", pa.int64()), ("_row", pa.int64()),
    ("first", pa.int64()), ("windows", pa.int64()),
]


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields)], names=[f[0] for f in fields])


def minimisers(words: list[bytes], window: int = WINDOW, part: int = MINIMISER) -> np.ndarray:
    """The minimiser of every window, as signed numbers."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    runs = run_hashes(word_hashes.of(words), part)
    n = len(words) - window + 1
    least = runs[:n].copy()
    for shift in range(1, window - part + 1):
        np.minimum(least, runs[shift:n + shift], out=least)
    return least.view(np.int64)


def super_kmers(minimiser: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every run of equal minimisers."""
    starts = np.flatnonzero(np.r_[True, minimiser[1:] != minimiser[:-1]]) if len(minimiser) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(minimiser)])


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, [(t or b"").split() for t in part.column(column).cast(pa.binary()).to_pylist()]


def super_kmers_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The super-k-mers of several texts at once: text, first window, windows and minimiser of each, in order."""
    sizes = np.array([len(words) for words in texts])
    windows = np.maximum(sizes - WINDOW + 1, 0)
    least = minimisers([w for words in texts for w in words])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
    place = np.arange(len(least)) - (ends - sizes)[text]
    inside = place < windows[text]  # else the window reaches into the next text
    text, place, least = text[inside], place[inside], least[inside]
    if not len(least):
        return text, place, np.zeros(0, np.int64), least
    starts = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    return text[starts], place[starts], np.diff(np.r_[starts, len(least)]), least[starts]


def _occurrences(docs: DataFrame, at: int) -> DataFrame:
    """(minimiser, row), once for each row. ``at``: where the text is; the row's hash comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, at):
            text, _, _, least = super_kmers_of(texts)
            order = np.lexsort((least, text))
            text, least = text[order], least[order]
            new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])][:len(least)]
            rows = part.column(part.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(least[new]), pa.array(rows[text[new]])], names=["minimiser", "_row"])

    return docs.mapInArrow(run, "minimiser long, _row long")


def _pairs(text: np.ndarray, minimiser: np.ndarray) -> np.ndarray:
    return seeded(minimiser.view(np.uint64) + mix(text.astype(np.uint64)), 3)


def _chosen(part: pa.RecordBatch, texts: list[list[bytes]], listed: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Text, first window, windows, minimiser and packed words of super-k-mers whose minimiser the row lists.

    Text and minimiser are compared by one hash of both: an equal hash of others could only make a
    super-k-mer travel in vain.
    """
    text, first, windows, least = super_kmers_of(texts)
    lists = _arrays(part.column(listed))
    asked = _pairs(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64))
    found = np.flatnonzero(np.isin(_pairs(text, least), asked))
    for i, p, n, m in zip(*(x[found].tolist() for x in (text, first, windows, least))):
        yield i, p, n, m, b" ".join(texts[i][p:p + n + WINDOW - 1])


def _packed(wanted: DataFrame, at: int) -> DataFrame:
    """Super-k-mers of minimisers that are shared and not hot, as packed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, at):
            rows, keys = part.column("_row").to_pylist(), part.column("_key").to_pylist()
            yield _batch([(m, packed, keys[i], rows[i], p, n) for i, p, n, m, packed in _chosen(part, texts, "_shared")], PACKED)

    return wanted.filter(F.size("_shared") > 0).mapInArrow(run, "minimiser long, " + PLACES.replace("W", "packed binary, "))


HOT = [("kind", pa.binary()), ("hashes", pa.binary()), *PACKED[2:5]]


def window_hashes(packed: bytes) -> bytes:
    """The 128-bit hashes of all windows of a super-k-mer, one after the other."""
    words = packed.split(b" ")
    return b"".join(xxhash.xxh3_128_digest(b" ".join(words[i:i + WINDOW])) for i in range(len(words) - WINDOW + 1))


def _hot_kmers(wanted: DataFrame, at: int) -> DataFrame:
    """Super-k-mers of hot minimisers: the hash of their words, and those of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, bytes]] = {}  # what is hot comes again and again
        for part, texts in _texts(batches, at):
            rows, keys = part.column("_row").to_pylist(), part.column("_key").to_pylist()
            out: list[tuple] = []
            for i, p, _, _, packed in _chosen(part, texts, "_hot"):
                if packed not in known:
                    if len(known) >= REMEMBERED_KMERS:
                        known.clear()
                    known[packed] = xxhash.xxh3_128_digest(packed), window_hashes(packed)
                out.append((*known[packed], keys[i], rows[i], p))
            yield _batch(out, HOT)

    return wanted.filter(F.size("_hot") > 0).mapInArrow(run, "kind binary, hashes binary, _key long, _row long, first long")


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def repeats_of_bucket(rows: list[tuple[bytes, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Repeated stretches (key, row, first window, windows) of one bucket's (packed, key, row, first, windows)."""
    kinds = {packed for packed, *_ in rows}
    least: dict[bytes, int] = {}
    if len(kinds) == 1:  # all super-k-mers equal: their windows have the same documents
        low = min(key for _, key, *_ in rows)
        return [(key, row, first, n) for _, key, row, first, n in rows if key > low]
    windows = {
        packed: [b" ".join(words[i:i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        for packed in kinds for words in [packed.split(b" ")]
    }
    lows: dict[bytes, int] = {}
    for packed, key, *_ in rows:
        if key < lows.get(packed, key + 1):
            lows[packed] = key
    for window, held in groupby(sorted((w, lows[p]) for p in kinds for w in windows[p]), lambda x: x[0]):
        least[window] = next(held)[1]
    out = []
    for packed, key, row, first, _ in rows:
        hit = np.array([least[w] < key for w in windows[packed]], np.int8)
        turns = np.flatnonzero(np.diff(np.r_[0, hit, 0]))
        out += [(key, row, first + int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2])]
    return out


def _bucket_repeats(packed: DataFrame) -> DataFrame:
    """Streams over sorted partitions, one bucket at a time."""
    ordered = (
        packed.repartition("minimiser").sortWithinPartitions("minimiser")
        .select("minimiser", "packed", "_key", "_row", "first", "windows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, []
        for batch in batches:
            out: list[tuple] = []
            for minimiser, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if minimiser != now:
                    if len(bucket) > 1:
                        out += repeats_of_bucket(bucket)
                    now, bucket = minimiser, []
                bucket.append(tuple(row))
            yield _batch(out, PACKED[2:])
        if len(bucket) > 1:
            yield _batch(repeats_of_bucket(bucket), PACKED[2:])

    return ordered.mapInArrow(run, PLACES.replace("W", ""))


def _hot_repeats(kmers: DataFrame) -> DataFrame:
    """The same for super-k-mers of hot minimisers, each different one taken apart once."""
    kinds = kmers.groupBy("kind").agg(F.min("_key").alias("_low"), F.min("hashes").alias("hashes"))
    places = F.sequence(F.lit(0), (F.octet_length("hashes") / 16).cast("int") - 1)
    windows = kinds.select("kind", "_low", F.posexplode(
        F.transform(places, lambda i: F.substring("hashes", i * 16 + 1, F.lit(16)))
    ).alias("at", "window"))
    least = windows.groupBy("window").agg(F.min("_low").alias("low"))
    lows = windows.join(least, "window").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("lows"))
    met = kmers.select("kind", "_key", "_row", "first").join(
        lows.select("kind", F.transform("lows", lambda x: x["low"]).alias("lows")), "kind"  # as long as the super-k-mer
    ).filter(F.array_min("lows") < F.col("_key")).select("_key", "_row", "first", "lows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, row, first, lows in zip(*(c.to_pylist() for c in batch.columns)):
                turns = np.flatnonzero(np.diff(np.r_[0, np.array(lows) < key, 0]))
                out += [(key, row, first + int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2])]
            yield _batch(out, PACKED[2:])

    return met.mapInArrow(run, PLACES.replace("W", ""))


def _copies(docs: DataFrame, text: str) -> DataFrame:
    """Rows whose whole text a row of a lesser key has too."""
    hashed = docs.filter(F.col(text).isNotNull()).select("_row", "_key", F.sha2(F.col(text).cast("binary"), 256).alias("_body"))
    firsts = hashed.groupBy("_body").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high")).filter("_low < _high")
    return hashed.join(firsts, "_body").filter("_key > _low").select("_row").distinct()


def stretches_of(kept: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last place of every run of marked places."""
    turns = np.flatnonzero(np.diff(np.r_[0, kept.astype(np.int8), 0])).tolist()
    return list(zip(turns[::2], turns[1::2]))


def cut_out(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, all between the words that stay beside each other left as it was.

    Where words went, a line break is left if there was one, else a space; none at the ends.
    """
    blank = np.isin(np.frombuffer(raw, np.uint8), _BLANKS)
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True]))
    starts, ends = edges[::2], edges[1::2]
    out, last = [], None
    for a, b in stretches_of(~gone):
        start, end = int(starts[a]), int(ends[b - 1])
        if last is not None:
            out.append(b"\n" if b"\n" in raw[last:start] else b" ")
        out.append(raw[start:end])
        last = end
    return b"".join(out)


def _without(rows: DataFrame, columns: list[str], text: str, trimmed: bool) -> DataFrame:
    """``rows`` (with their repeated stretches) with the words kept and the counts."""
    at, results = columns.index(text), RESULTS | (TRIMMED if trimmed else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, at):
            keys, copies, stretches = (part.column(c).to_pylist() for c in ("_key", "_copy", "_stretches"))
            made: dict[str, list] = {name: [] for name in results}
            said = part.column(at).cast(pa.binary()).to_pylist()
            for raw, words, key, copy, own in zip(said, texts, keys, copies, stretches):
                gone = np.full(len(words), bool(copy) and len(words) >= WINDOW)
                for s in own or ():
                    if s["_key"] == key:  # else another row of the same hash
                        gone[s["first"]:s["first"] + s["windows"] + WINDOW - 1] = True
                n = int(gone.sum())
                left = words if not n else [w for a, b in stretches_of(~gone) for w in words[a:b]]
                made["kept_text"].append(b" ".join(left))
                made["n_words"].append(len(words))
                made["n_removed"].append(n)
                if trimmed:
                    made["trimmed_text"].append(cut_out(raw, gone) if n else raw)
            arrays = [
                pa.array(made[name], pa.binary()).cast(kind) if kind == pa.string() else pa.array(made[name], kind)
                for name, kind in results.items()
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(columns)], *arrays], names=[*columns, *results])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema]
    fields += [f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in results.items()]
    return rows.select(*columns, "_key", "_copy", "_stretches").mapInArrow(run, ", ".join(fields))


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS, trimmed: bool = False,
) -> DataFrame:
    """``df`` with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``, and with ``trimmed`` also
    ``trimmed_text`` (the text with the other words cut out and its line breaks kept). Columns of these names give way.
    """
    df = df.drop(*RESULTS, *(TRIMMED if trimmed else ()))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, at = df.columns, df.columns.index(text)
    order = F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("_key")
    # A row goes by a hash of key and text, so that rows that share a key stay apart.
    docs = df.withColumn("_row", F.xxhash64(F.col(key), F.col(text)))
    # The texts are dealt once; every step below asks for the same columns, so Spark reuses the shuffle.
    copies = _copies(docs.select("_row", order, text), text).withColumn("_copy", F.lit(True))
    dealt = docs.repartition(parts, "_row").join(copies.hint("shuffle_hash"), "_row", "left")
    # a copy is known to be repeated as a whole, and its windows are no news to others
    open_ = dealt.filter("_copy IS NULL").select(*columns, "_row")
    found = _occurrences(open_, at)
    shared = found.groupBy("minimiser").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    cool = F.when(F.col("held") <= hot_rows, F.col("minimiser"))
    hot = F.when(F.col("held") > hot_rows, F.col("minimiser"))
    marked = found.join(shared.hint("shuffle_hash"), "minimiser").groupBy("_row").agg(
        F.collect_list(cool).alias("_shared"), F.collect_list(hot).alias("_hot")  # bounded by the text
    )
    wanted = open_.join(marked, "_row").select(*columns, "_row", order, "_shared", "_hot")
    repeats = _bucket_repeats(_packed(wanted, at)).unionByName(_hot_repeats(_hot_kmers(wanted, at)))
    stretches = repeats.groupBy("_row").agg(
        F.collect_list(F.struct("_key", "first", "windows")).alias("_stretches")  # bounded by the text
    )
    last = dealt.join(stretches, "_row", "left").select(*columns, order, "_copy", "_stretches")
    return _without(last, columns, text, trimmed)
