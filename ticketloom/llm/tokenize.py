"""Token counts by a public tokenizer, in batches balanced by bytes, long texts split where it is safe.

A text may be cut before a single space or line feed that stands between two characters that are not
white space, where the file has the plain byte-level pre-tokenizer, which never forms a token across such
a place, and no special string with white space. With any other file every text is one call. Long texts are encoded in blocks between such places, so that no call of the
library holds more than a block's offsets; batches of blocks are about equal in bytes. The ids are
exactly those that the library gives for the whole text, also of very long runs of white space.

Null and empty texts have no tokens. Texts of any length are read whole. Only the columns asked for
are kept, so extra columns of the input never clash; rows that repeat stay repeated.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Bytes of the texts that are encoded together, and characters of a block.
BATCH_BYTES, BLOCK_CHARS = 1 << 20, 1 << 15
# White space in any reading of the word, and invisible characters that some readings count as such.
_ODD = r"\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff"
# Fixed value: how the byte-level pre-tokenizer cuts text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A run of white space this long goes through the library itself: the other's pattern gives up near a million.
_LONG_BLANK = re.compile(r"\s{100000}")
_SAFE = re.compile(f"(?<=[^{_ODD}])(?=[ \n][^{_ODD}])")


def blocks_of(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """The text in blocks of ``size`` characters or more, cut only where no token can lie across."""
    cuts, at = [0], size
    while found := _SAFE.search(text, at):
        cuts.append(found.start())
        at = found.start() + size
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def ranked_encoding(path: str):
    """The same byte-level BPE run by tiktoken, some five times as fast, and a pattern of its specials.

    Only for a file whose ids below the specials are the ranks of its merges and that has nothing
    but the plain byte-level pre-tokenizer; for any other (None, None), and the tokenizers library
    does the work itself. The tests compare the two on every code point.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    bpe, pre = model["model"], model.get("pre_tokenizer") or {}
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if (bpe.get("type") != "BPE" or any(pre.get(k) != v for k, v in wanted.items()) or model.get("normalizer")
            or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                        "byte_fallback", "ignore_merges"))):
        return None, None
    added = model.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None, None
    # Byte-level files write a byte that does not print as the next free code point from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    specials = {t["content"]: t["id"] for t in added}
    vocab = {w: i for w, i in bpe["vocab"].items() if w not in specials}
    merges = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
    first = len(vocab) - len(merges)
    if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None, None
    ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in vocab.items()}
    pattern = re.compile("|".join(map(re.escape, specials))) if specials else None
    return tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=specials), pattern


class Encoder:
    """Whole texts to ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked, self.special = ranked_encoding(path)
        odd = re.compile(f"[{_ODD}]")
        self.cuts = bool(self.ranked) and not any(map(odd.search, self.ranked.special_tokens_set))

    def blocks(self, blocks: list[str]) -> list[np.ndarray]:
        if not self.ranked:
            made = self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in made]
        run, special = self.ranked.encode_to_numpy, self.special

        def one(block: str) -> np.ndarray:
            if len(block) >= 100_000 and _LONG_BLANK.search(block):
                return np.array(self.tokenizer.encode(block, add_special_tokens=False).ids, np.uint32)
            return run(block, allowed_special="all" if special and special.search(block) else set(), disallowed_special=())

        return [one(b) for b in blocks]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizers library gives them."""
        cut = [blocks_of(t) if self.cuts and len(t) > BLOCK_CHARS else [t] for t in texts]
        ids = iter(self.blocks([b for own in cut for b in own]))
        return [np.concatenate([next(ids) for _ in own]) if len(own) > 1 else next(ids) for own in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_lengths(texts: pa.Array) -> list[int]:
    """The UTF-8 bytes of every text; none for a null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def balanced(lengths: list[int], size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each; a longer text is a range of its own."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def token_counts(df: DataFrame, text: str, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of every text."""
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts, sizes = [t or "" for t in batch.column(len(keep)).to_pylist()], byte_lengths(batch.column(len(keep)))
            counts: list[int] = []
            for a, b in balanced(sizes):
                counts += map(len, encode(texts[a:b]))
            made = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "n_bytes", "n_tokens"])

    return df.select(*keep, text).mapInArrow(count, schema)


def with_tokens(df: DataFrame, text: str, path: str, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep``, which may hold the text itself, with the tokens of every text as ``name``."""
    read = keep if text in keep else [*keep, text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = [t or "" for t in batch.column(read.index(text)).to_pylist()]
            counts: list[int] = []
            for a, b in balanced(byte_lengths(batch.column(read.index(text)))):
                counts += map(len, encode(texts[a:b]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, name])

    return df.select(*read).mapInArrow(count, schema)
