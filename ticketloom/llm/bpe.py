"""Byte-level BPE by replaying merges over all words of a block of the corpus at once.

A pattern cuts every text into words; each distinct word of a block of texts is encoded once. An inverted
index names, for every token pair that the vocabulary can merge, the places where it stands in any word
of the block. Merges are applied in the order of their ranks, each at all places of its pair in one
step, and only the pairs to the left and right of a place change in the index. Where a merge makes a pair
of no greater rank than its own, the order within a word would matter: such a word is replayed apart,
place by place, the lesser rank first and the leftmost of equal ones, which is the definition.

A block is a bounded number of characters of one task's texts; its distinct words, its documents as
numbers of these words and its index are all a task holds. Nothing is shuffled or passes the driver. (Words
of all blocks can be made distinct by a shuffle too, but then the documents, as numbers, have to be
shuffled to meet them again.)

Decoding joins the bytes of the ids; the bytes of a whole encoding are the text's.

A null text counts as empty and has no ids. Long texts are cut and encoded whole, also those without any
white space and those of nothing else. Repeated rows stay repeated. Empty tables give empty results. Only
the columns asked for are kept, under any names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Characters of the texts of a block.
BLOCK_CHARS = 1 << 23
# Fewer bytes of words than this are replayed place by place, which then is faster.
FEW_BYTES = 1 << 16
# Documents of one batch that a task hands out.
BATCH_DOCS = 256


class Ranks:
    """Every token's bytes and its rank, which is its id."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self._merged: dict[tuple[int, int], int] = {}
        pairs = sorted(
            (left * len(self.token) + right, rank) for token, rank in self.rank.items() for cut in range(1, len(token))
            if (left := self.rank.get(token[:cut], -1)) >= 0 <= (right := self.rank.get(token[cut:], -1))
        )
        self._pairs = np.array([p for p, _ in pairs], np.int64)
        self._pair_ranks = np.array([r for _, r in pairs], np.int64)

    def merged(self, left: int, right: int) -> int:
        """The rank of the merge of two tokens, -1 if the vocabulary has none."""
        found = self._merged.get((left, right))
        if found is None:
            if len(self._merged) > 1 << 20:
                self._merged.clear()
            found = self._merged[left, right] = self.rank.get(self.token[left] + self.token[right], -1)
        return found


    def merged_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same for arrays of tokens; a token below 0 merges with none."""
        wanted = np.where((left >= 0) & (right >= 0), left * len(self.token) + right, -1)
        at = np.searchsorted(self._pairs, wanted)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == wanted, self._pair_ranks[at], -1) if len(self._pairs) else wanted * 0 - 1


_ranks: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    """One table for each file in a Python worker."""
    if path not in _ranks:
        with open(path, "rb") as file:
            _ranks[path] = Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})
    return _ranks[path]


def replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of every word, by applying each merge to all words in the order of ranks."""
    word = ranks.rank.get
    done = [word(w) for w in words]  # a word that is a token needs no merge
    token: list[int] = []
    starts = []
    for w, known in zip(words, done):
        starts.append(len(token))
        if known is None:
            token += map(ranks.byte.__getitem__, w)
            token.append(-1)  # no pair reaches over the end of a word
    after = list(range(1, len(token) + 1))
    before = list(range(-1, len(token) - 1))
    places: dict[int, list[int]] = {}  # rank of the pair's merge: where the left token stands
    merged = ranks.merged
    for at in range(len(token) - 1):
        if token[at] >= 0 <= token[at + 1] and (rank := merged(token[at], token[at + 1])) >= 0:
            places.setdefault(rank, []).append(at)
    waiting = list(places)
    heapify(waiting)
    while waiting:
        rank = heappop(waiting)
        found = places.pop(rank, ())
        found = sorted(found)
        for i, at in enumerate(found):
            left, n = token[at], after[at]
            # a place is stale where an earlier merge took its token or its neighbour
            if left < 0 or token[n] < 0 or merged(left, token[n]) != rank:
                continue
            token[at], token[n] = rank, -2
            follow = after[at] = after[n]
            before[follow] = at
            lesser = False
            b = before[at]
            for place, x, y in ((b, token[b] if b >= 0 else -1, rank), (at, rank, token[follow])):
                if x >= 0 <= y and (new := merged(x, y)) >= 0:
                    if new not in places:
                        places[new] = []
                        heappush(waiting, new)
                    places[new].append(place)
                    lesser |= new <= rank
            if lesser and i + 1 < len(found):  # what is left of this merge waits for the lesser one
                if rank not in places:
                    places[rank] = []
                    heappush(waiting, rank)
                places[rank] += found[i + 1:]
                break
    out = []
    for start, known in zip(starts, done):
        if known is not None:
            out.append([known])
            continue
        ids, at = [], start
        while token[at] != -1:
            ids.append(token[at])
            at = after[at]
        out.append(ids)
    return out


def replay_block(words: list[bytes], ranks: Ranks, few: int = FEW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and how many each has: each merge at all its places at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if lengths.sum() < few:
        ids = replay(words, ranks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for own in ids for x in own), np.int32, int(sizes.sum())), sizes
    # a word's bytes and a mark that no pair reaches over
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    inner = np.ones(len(owner), bool)
    inner[np.cumsum(lengths + 1) - 1] = False
    token = np.full(len(owner), -1, np.int64)
    token[inner] = np.array(ranks.byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
    odd: list[np.ndarray] = []

    first = ranks.merged_all(token[:-1], token[1:])
    places = np.flatnonzero(first >= 0)
    places = places[np.argsort(first[places], kind="stable")]
    known, cuts = np.unique(first[places], return_index=True)
    ends = np.append(cuts[1:], len(places))
    start = {rank: (a, b) for rank, a, b in zip(known.tolist(), cuts.tolist(), ends.tolist())}
    later: dict[int, list[int]] = {}
    waiting = list(start)
    heapify(waiting)
    while waiting:
        rank = heappop(waiting)
        a, b = start.pop(rank, (0, 0))
        found, more = places[a:b], later.pop(rank, None)
        if more:
            found = np.unique(np.concatenate([found, more]))  # a place may be entered from both sides
        # a place is stale where another merge took its token or its neighbour
        found = found[ranks.merged_all(token[found], token[after[found]]) == rank]
        if len(found) > 1:
            chained = after[found[:-1]] == found[1:]
            if chained.any():  # of places that share a token every second one, from the left
                at = np.arange(len(found))
                begin = np.maximum.accumulate(np.where(np.append(True, ~chained), at, 0))
                found = found[(at - begin) % 2 == 0]
        if not len(found):
            continue
        gone = after[found]
        follow = after[gone]
        right = token[follow]  # before a merge there
        token[found], token[gone] = rank, -2
        after[found], before[follow] = follow, found
        b = before[found]
        left = np.where(b >= 0, token[b], -1)
        spots = np.concatenate([b, found])
        made = ranks.merged_all(np.concatenate([left, token[found]]), np.concatenate([token[found], token[follow]]))
        passing = ranks.merged_all(token[found], right)
        early = ((made >= 0) & (made <= rank)).reshape(2, -1).any(axis=0) | ((passing >= 0) & (passing <= rank))
        if early.any():
            odd.append(owner[found[early]])
        open_ = made > rank
        for new, place in zip(made[open_].tolist(), spots[open_].tolist()):
            held = later.get(new)
            if held is None:
                later[new] = [place]
                if new not in start:
                    heappush(waiting, new)
            else:
                held.append(place)
    alive = token >= 0
    ids, sizes = token[alive].astype(np.int32), np.bincount(owner[alive], minlength=len(words))
    if odd:
        again = np.unique(np.concatenate(odd))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, own in zip(again.tolist(), replay([words[i] for i in again.tolist()], ranks)):
            parts[i], sizes[i] = np.array(own, np.int32), len(own)
        ids = np.concatenate(parts)
    return ids, sizes


class _Numbers(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: str) -> int:
        made = self[word] = len(self)
        return made


def _coded(block: list[tuple[list[pa.Array], list[np.ndarray]]], numbers: _Numbers, ranks: Ranks, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The documents of a block, each with its ids."""
    flat, sizes = replay_block([w.encode() for w in numbers], ranks)
    starts = np.cumsum(sizes) - sizes
    for columns, places in block:
        words = np.concatenate(places)
        lengths = sizes[words]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[words] - (ends - lengths), lengths) + np.arange(total)]
        cuts = np.cumsum([0, *map(len, places)])
        offsets = np.append(0, ends)[cuts]
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([*columns, made], names=names)


def encode(
    df: DataFrame, text: str, path: str, pattern: str, keep: list[str], name: str = "ids", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The columns ``keep`` with the ids of every text as an array ``name``."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks = regex.compile(pattern).findall, ranks_of(path)
        block, held, numbers = [], 0, _Numbers()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                places = []
                for said in part.column(part.num_columns - 1).to_pylist():
                    places.append(np.fromiter(map(numbers.__getitem__, find(said or "")), np.int32))
                    held += len(said or "")
                block.append((part.columns[:-1], places))
                if held >= block_chars:
                    yield from _coded(block, numbers, ranks, schema.names)
                    block, held, numbers = [], 0, _Numbers()
        yield from _coded(block, numbers, ranks, schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its array ``ids`` stands for, as ``name``. Null ids give no bytes."""
    at = df.columns.index(ids)
    schema = T.StructType([*df.schema, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = ranks_of(path).token.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                made = [b"".join(map(token, own or ())) for own in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)
