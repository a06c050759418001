"""Near-duplicate documents: DartMinHash signatures, banded joins, exact checks, connected classes.

A document is the multiset of its runs of five words. Every copy of a run is a region of unit weight,
into which hashed darts fall: the n-th dart of a region has a rank that depends on the region alone
and grows with n like a random arrival time. Ranks up to a limit are thrown, about as many darts as
the signature needs whatever the document's length. A hash deals the darts to coordinates, and the
earliest dart of a coordinate is its signature; a limit that left a coordinate empty is doubled. Two
documents have the same dart in a coordinate with the probability of their weighted Jaccard likeness.

Five coordinates make a band, 32 bands a signature: two documents of likeness 0.8 miss each other in
all bands with a chance of 3 in a million. Texts with the same words are one text from the start. In a
bucket of a band all texts are compared with its centre, the text that meets most others over all its
buckets: among copies of one text that are less like each other than like it, that is the text itself.
Then, where a bucket still holds texts of several classes, those outside its largest class meet all of
other classes in blocks of the bucket, inside tasks and without a row for any pair, so no pair that
shares a bucket stays open unless both ends are in one class already. A pair whose signatures agree so
seldom that a likeness of 0.8 is out of the question (by five and a half standard deviations, on four
bits of each coordinate) is passed over. Each comparison computes the likeness exactly. Classes are the connected components
of the links, by alternating star contractions on tables.

Nulls: a null text counts as empty. Texts without words have no runs and are alone in their class,
texts of fewer than five words are one run. A row has the class of its text, so rows that share a key but
not their words may be of different classes. An empty table gives an empty result. Only key and text are read, so extra columns never clash. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.hashing import run_hashes, seeded, word_hashes
from ticketloom.session import materialise

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes of a text and how often each occurs."""
    h = word_hashes.of((text or "").encode().split())
    if 0 < len(h) < words:
        return run_hashes(h, len(h)), np.ones(1, np.int64)
    return np.unique(run_hashes(h, words), return_counts=True)


def signature(runs: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of every coordinate, as the dart's number. ``runs`` must not be empty."""
    total = int(counts.sum())
    if total > len(runs):  # a region for every copy of a run
        first = np.cumsum(counts) - counts
        layer = np.arange(total) - np.repeat(first, counts)
        regions = seeded(np.repeat(runs, counts) + layer.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 0)
    else:
        regions = seeded(runs, 0)
    limit = size * (log(size) + 3) / total
    while True:
        ranks, darts = [], []
        open_, rank, n = regions, np.zeros(total), 0
        while len(open_):
            n += 1
            dart = seeded(open_, n)
            rank = rank - np.log1p(-((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53))
            hit = rank < limit
            open_, rank = open_[hit], rank[hit]
            ranks.append(rank)
            darts.append(dart[hit])
        rank, dart = np.concatenate(ranks), seeded(np.concatenate(darts), 0)
        order = np.argsort(-rank, kind="stable")  # the earliest last, so that it stays
        at = (dart % np.uint64(size)).astype(np.int64)
        made, filled = np.zeros(size, np.uint64), np.zeros(size, bool)
        made[at[order]] = dart[order]
        filled[at] = True
        if filled.all():
            return made
        limit *= 2


# Coordinates that agree, of 160 with four bits each, for a likeness of 0.8: 130 expected, deviation 4.9.
LEAST_AGREEING = 103


def sketch_of(made: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate, sixteen to a number."""
    nibbles = (made >> np.uint64(40) & np.uint64(15)).reshape(-1, 16)
    return (nibbles << (4 * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each of the sketches ``a`` agrees with each of ``b``."""
    ones, total = np.uint64(0x1111111111111111), np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        d = a[:, None, i] ^ b[None, :, i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        total += 16 - np.bitwise_count(d & ones)
    return total


def bands_of(made: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for every band of a signature."""
    cells = made.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64)
    for column in cells.T:
        out = seeded(out ^ column, 1)
    return out.view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two multisets of runs."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``body`` (a 128-bit hash of the words, null without any), ``bands`` and ``sketch`` of every row."""

    def listed(rows: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                bodies, bands, sketches = [], [], []
                for said in part.column(1).to_pylist():
                    words = (said or "").encode().split()
                    bodies.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    made = signature(*shingles(said)) if words else None
                    bands.append(bands_of(made) if words else np.zeros(0, np.int64))
                    sketches.append(sketch_of(made) if words else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bodies, pa.binary()), listed(bands), listed(sketches)],
                    names=["id", "body", "bands", "sketch"],
                )

    kind = df.select(key).schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"id {kind}, body binary, bands array<bigint>, sketch array<bigint>")


def shingled(df: DataFrame) -> DataFrame:
    """``id`` with its runs and counts as bytes, from ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                made = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([u.tobytes() for u, _ in made], pa.binary()),
                     pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary())],
                    names=["id", "runs", "counts"],
                )

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInArrow(run, f"id {kind}, runs binary, counts binary")


def checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose likeness is at least the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("a_runs"), F.col("counts").alias("a_counts"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("b_runs"), F.col("counts").alias("b_counts"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_runs", "a_counts", "b_runs", "b_counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pair(runs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(runs, np.uint64), np.frombuffer(counts, "<u4").astype(np.int64)

        for batch in batches:
            columns = [batch.column(c) for c in range(2, 6)]
            like = [
                likeness(pair(columns[0][i].as_py(), columns[1][i].as_py()), pair(columns[2][i].as_py(), columns[3][i].as_py()))
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array([x >= threshold for x in like], pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``class``, the least id it is linked to, of every id in links (``a``, ``b``).

    Alternates two contractions until nothing moves: every node hands its larger neighbours to the
    least id it knows, then its smaller ones. A node's neighbours are never gathered: the least is an
    aggregate, handing over is a join, which adaptive execution splits at hubs.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("lo")).select(
            F.col("hi").alias("node"), F.least("hi", "lo").alias("least")
        )
        larger = edges.select(F.col("lo").alias("node"), "hi")  # for a node, its larger neighbours
        handed = larger.join(least, "node").select("hi", F.col("least").alias("lo")).distinct()
        least = handed.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = handed.join(least, "hi").select(
            F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo")
        ).filter("hi <> lo").distinct()
        edges = materialise(moved, "links")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before:
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("class"))
        before = seen


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: its key and ``class_id``, the least key of its class.

    Bands and the filter on sketches are laid out for a likeness of 0.8: a lower threshold is refused.
    """
    if not threshold >= THRESHOLD:
        raise ValueError(f"threshold {threshold} is below {THRESHOLD}: the bands would miss pairs of that likeness")
    rows = materialise(signed(df, key, text), "signatures")
    worded = rows.filter("body IS NOT NULL")
    firsts = materialise(worded.groupBy("body").agg(F.min("id").alias("id")), "texts")
    # one row a text: those whose key is the least of their body
    texts = worded.join(firsts.withColumnRenamed("id", "first"), "body").filter("id = first")
    banded = texts.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = materialise(banded.join(buckets.hint("shuffle_hash"), "band").select("band", "id", "held"), "members")
    involved = members.select("id").distinct()
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sets = materialise(shingled(source.join(involved, "id", "left_semi")), "shingles")

    met = members.groupBy("id").agg(F.sum("held").alias("met"))
    centres = members.join(met, "id").groupBy("band").agg(F.max_by("id", F.struct("met", "id")).alias("centre"))
    spokes = members.join(centres, "band").filter(F.col("id") != F.col("centre"))
    tried = materialise(
        spokes.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs"
    )
    links = materialise(checked(tried, sets, threshold), "found")
    found = components(links)
    sketches = rows.select("id", "sketch").join(involved, "id", "left_semi")
    more = _links_between_classes(members, found, sketches, sets, threshold)
    if more is not None:
        found = components(links.union(more))

    classed = firsts.join(found, "id", "left").select("body", F.coalesce("class", "id").alias("class_id"))
    return rows.join(classed, "body", "left").select(
        F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id")
    )


# Texts of a bucket that meet in one block; a larger bucket is dealt over pairs of blocks.
BLOCK = 500


def _links_between_classes(members: DataFrame, found: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """Links of buckets that hold several classes: those outside the largest against all of other classes.

    A bucket's texts meet in blocks, so no pair makes a row. First their sketches do, and only texts
    with a partner that may be alike go on; then their runs do. Once linked, two classes are one within
    the block, and no further pair of them is compared.
    """
    classed = materialise(
        members.join(found, "id", "left").select("band", "id", F.coalesce("class", "id").alias("class")), "classed"
    )
    sizes = classed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(
        F.max(F.struct("n", "class")).alias("_top"), F.sum("n").alias("held"), F.count(F.lit(1)).alias("classes")
    ).filter("classes > 1").select(
        "band", F.col("_top.class").alias("main"), F.ceil(F.col("held") / BLOCK).alias("blocks"),
        F.ceil((F.col("held") - F.col("_top.n")) / BLOCK).alias("query_blocks"),
    )
    mixed = classed.join(largest, "band")
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = mixed.select("band", "id", "class", F.lit(False).alias("asks"), own(1, "blocks").alias("block"), every("query_blocks").alias("query_block"))
    asking = mixed.filter(F.col("class") != F.col("main")).select(
        "band", "id", "class", F.lit(True).alias("asks"), every("blocks").alias("block"), own(2, "query_blocks").alias("query_block")
    )
    place = ["band", "block", "query_block"]
    rows = held.unionByName(asking)
    kind = members.schema["id"].dataType.simpleString()

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*place).sortWithinPartitions(*place)

    sketched = rows.join(sketches.dropDuplicates(["id"]), "id").select(*place, "id", "class", "asks", "sketch")
    schema = f"band long, block long, query_block long, id {kind}, class {kind}, asks boolean, sketch array<bigint>"
    likely = materialise(dealt(sketched).mapInArrow(_blockwise(_likely), schema), "likely")
    if likely.isEmpty():
        return None
    full = likely.join(sets, "id").select(*place, "id", "class", "asks", "sketch", "runs", "counts")
    exact = lambda block: _linked(block, threshold)
    return materialise(dealt(full).mapInArrow(_blockwise(exact), f"a {kind}, b {kind}"), "found")


def _blockwise(work: Callable[[pa.Table], pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the rows of each block, from rows sorted by their first three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            before = [waiting[-1].column(i)[-1].as_py() for i in range(3)] if waiting else None
            for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if waiting and (n or before != keys[0].tolist()):
                    yield from _emitted(work(pa.Table.from_batches(waiting)))
                    waiting = []
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from _emitted(work(pa.Table.from_batches(waiting)))

    return run


def _emitted(made: pa.Table | None) -> list[pa.RecordBatch]:
    return made.combine_chunks().to_batches() if made is not None and made.num_rows else []


def _candidates(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that ask, rows that are held, and how far the pairs agree that may be alike (else 0)."""
    asks = block.column("asks").to_numpy()
    asking, held = np.flatnonzero(asks), np.flatnonzero(~asks)
    width = BANDS * ROWS // 16
    sketches = block.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)
    agree = agreeing(sketches[asking], sketches[held])
    classes = block.column("class").to_numpy()
    agree[(agree < LEAST_AGREEING) | (classes[asking][:, None] == classes[held][None, :])] = 0
    return asking, held, agree


def _likely(block: pa.Table) -> pa.Table | None:
    asking, held, agree = _candidates(block)
    chosen = np.concatenate([asking[agree.any(axis=1)], held[agree.any(axis=0)]])
    return block.take(pa.array(chosen)) if len(chosen) else None


def _linked(block: pa.Table, threshold: float) -> pa.Table | None:
    """A link for every two classes of the block that some pair joins, likeliest pairs first."""
    asking, held, agree = _candidates(block)
    ids, classes = block.column("id"), block.column("class").to_pylist()
    runs = [np.frombuffer(x, np.uint64) for x in block.column("runs").to_pylist()]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in block.column("counts").to_pylist()]
    parent = {c: c for c in classes}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    rows, columns = np.nonzero(agree)
    order = np.argsort(-agree[rows, columns], kind="stable")
    for i, j in zip(asking[rows[order]].tolist(), held[columns[order]].tolist()):
        x, y = root(classes[i]), root(classes[j])
        if x != y and likeness((runs[i], counts[i]), (runs[j], counts[j])) >= threshold:
            parent[x] = y
            found.append((i, j))
    if not found:
        return None
    a, b = (ids.take(pa.array(side)) for side in zip(*found))
    return pa.table({"a": a, "b": b})
