"""Importance resampling, corpus-level BPE and hard negatives: brute force, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm import brute
from ticketloom.llm import bpe, hard_negatives, importance
from ticketloom.llm.queries import RANK_FILE, REGISTRY

DRAW = random.Random(5)


def prose(n):
    return " ".join(DRAW.choices([f"w{i}" for i in range(300)], k=n))


LONG = prose(20_000)
TEXTS = [
    (1, "One, TWO two\x0bÉTÉ été 3rd-degree"), (2, None), (3, ""), (4, " \n\t "), (5, prose(30)), (6, LONG), (7, LONG + " x"),
    (8, "don't  stop\n\n\n now 123456 #$% 長い文章 a b  c"), (9, "a" * 3000), (9, "a" * 3000), (9, prose(25)), (None, prose(22)),
    (10, "ab" * 5000 + " " * 5000 + "end"), (11, " " * 3000), *((i, prose(24)) for i in range(20, 120)),
]
# Names that the operators use inside themselves, or give.
EXTRA = ["ids", "rank", "score", "weight", "buckets", "n_words", "n_features", "question", "key", "decoded", "label2", "_word"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, *("x" for _ in EXTRA)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


# --- importance ---------------------------------------------------------------------------------

def brute_importance(rows, aims, longest=1, buckets=10_000, percent=10):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [crc32(r.encode()) % buckets for r in runs]

    held = [(i, *features(t)) for i, t in rows]
    s, t = (Counter(b for own in lists for b in own) for lists in ([h[2] for h in held], [features(x)[1] for x in aims]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for i, n, own in held:
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(own), weight, score))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    place = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r, place.get(id(r))) for r in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 100, 50), (3, 64, 100)])
def test_importance(spark, texts, longest, buckets, percent):
    aims = [prose(40), None, "two ÉTÉ 3rd"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id long, text string")
    made = importance.resample(texts, target, longest=longest, buckets=buckets, percent=percent)
    assert ordered(made.collect()) == ordered(brute_importance(TEXTS, aims, longest, buckets, percent))


def test_importance_of_nothing(spark, texts):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(texts.limit(0), target).count() == 0
    made = importance.resample(texts, target)
    assert ordered(made.collect()) == ordered(brute_importance(TEXTS, []))


def test_bit_planes():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 10_000):
        counts, gain = rng.integers(0, 5000, n) * (rng.random(n) < 0.2), rng.integers(-9000, 9000, n)
        assert importance.weighed_sum(counts, *importance.signed_planes(gain)) == int(counts @ gain)
    assert importance.weighed_sum(np.zeros(5, np.int64), *importance.signed_planes(np.zeros(5, np.int64))) == 0


# --- BPE ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(RANK_FILE).rank, special_tokens={})


@pytest.mark.parametrize("block_chars", [bpe.BLOCK_CHARS, 500])
def test_bpe(spark, texts, library, block_chars):
    made = bpe.encode(texts, "text", RANK_FILE, PATTERN, ["doc_id", "label2", "_word"], "ids", block_chars)
    found = bpe.decode(made, "ids", RANK_FILE).collect()
    assert made.columns == ["doc_id", "label2", "_word", "ids"] and {r.label2 for r in found} == {"x"}
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS]
    assert ordered((r.doc_id, r.ids, bytes(r.decoded)) for r in found) == ordered(want)


def test_bpe_of_nothing(spark, texts):
    assert bpe.encode(texts.limit(0), "text", RANK_FILE, PATTERN, ["doc_id"]).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [72, 105])], "i long, ids array<int>")
    ranks = bpe.ranks_of(RANK_FILE)
    assert {r.i: bytes(r.decoded) for r in bpe.decode(nulls, "ids", RANK_FILE).collect()} == {1: b"", 2: b"", 3: ranks.token[72] + ranks.token[105]}


def test_white_space_beyond_the_library(spark):
    """A million blanks, which the library's pattern gives up on: all but the last, then the rest."""
    text = " " * 1_000_001 + "end"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = bpe.decode(bpe.encode(rows, "text", RANK_FILE, PATTERN, ["doc_id"]), "ids", RANK_FILE).first()
    assert bytes(made.decoded).decode() == text


def test_replay_is_the_library_word_by_word(library):
    ranks = bpe.ranks_of(RANK_FILE)
    words = ["".join(DRAW.choices("aabcdeé長ßtionre", k=DRAW.randint(1, 30))) for _ in range(5000)]
    words += ["a" * n for n in range(1, 70)] + ["".join(chr(DRAW.randint(0x21, 0x2FF)) for _ in range(9)) for _ in range(3000)]
    words = [w.encode() for w in dict.fromkeys(words)]
    want = [library._core_bpe.encode_single_piece(word) for word in words]
    assert bpe.replay(words, ranks) == want
    ids, sizes = bpe.replay_block(words, ranks, few=0)
    assert [own.tolist() for own in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_replay_where_a_merge_makes_an_earlier_one():
    """Ranks for which all places at once would go wrong: such words are replayed apart."""
    tokens = [b"abc", b"ab", b"bc", b"cab", b"aa", b"aaa", b"bcab"]
    for order in range(200):
        DRAW.shuffle(tokens)
        table = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        ranks = bpe.Ranks(table)
        words = ["".join(DRAW.choices("abc", k=DRAW.randint(1, 12))).encode() for _ in range(100)]
        library = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=table, special_tokens={})
        want = [library._core_bpe.encode_single_piece(w) for w in words]
        assert bpe.replay(words, ranks) == want
        ids, sizes = bpe.replay_block(words, ranks, few=0)
        assert [own.tolist() for own in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_every_code_point(library):
    import regex

    find, ranks = regex.compile(PATTERN).findall, bpe.ranks_of(RANK_FILE)
    texts = []
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            texts.append(f"a{x}{x} 1{x}  {x}!")
    cut = [find(t) for t in texts]
    for text, words in zip(texts, cut):
        assert [i for w in words for i in library._core_bpe.encode_single_piece(w.encode())] == library.encode_ordinary(text)
    few = [w.encode() for w in dict.fromkeys(w for words in cut[::97] for w in words)]
    assert bpe.replay(few, ranks) == [library._core_bpe.encode_single_piece(w) for w in few]


def test_bpe_query(spark, library):
    found = {r.doc_id: r for r in REGISTRY["op12_bpe"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(rows)
    for d in rows:
        ids, r = library.encode_ordinary(d.text or ""), found[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- hard negatives -------------------------------------------------------------------------------

def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = list(dict.fromkeys((k, tuple(v), c) for k, v, c in rows if k is not None and v is not None and c is not None and None not in v))
    out = []
    for a in rows:
        if a[0] not in anchors:
            continue
        scored = sorted((-int(np.dot(a[1], r[1])), r[0], r[2]) for r in rows if r != a and len(r[1]) == len(a[1]))
        for p in [x for x in scored if x[2] == a[2]][:positives]:
            fits = [x for x in scored if x[2] != a[2] and -low * p[0] <= -100 * x[0] <= -high * p[0]]
            out += [(a[0], p[1], n + 1, x[1], -p[0], -x[0]) for n, x in enumerate(fits[:negatives])]
    return out


def vectors(n, dims, seed, spread=60):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, dims))
    return [[int(x) for x in centres[rng.integers(6)] + rng.integers(-spread, spread + 1, dims)] for _ in range(n)]


@pytest.mark.parametrize("dims,spread,block", [(3, 60, 40), (16, 20, 10_000), (16, 200, 100)])
def test_hard_negatives(spark, dims, spread, block):
    rows = [(i, v, i * 7 % 4) for i, v in enumerate(vectors(700, dims, dims + spread, spread))]
    rows += [(1000 + i, rows[30][1], 30 * 7 % 4) for i in range(200)]  # a vector that many rows share
    rows += [(2000 + i, rows[31][1], i % 4) for i in range(60)] + rows[:40]  # other labels too; repeated rows
    rows += [(3000, None, 1), (3001, [1, None, 2], 1), (None, rows[0][1], 2), (3002, rows[0][1], None), (3030, [0] * dims, 1), (3031, [5], 1), (3040, [], 1)]
    DRAW.shuffle(rows)
    df = spark.createDataFrame([(k, v, c, "x", "y", "z") for k, v, c in rows], "vec_id long, vector array<long>, label int, question string, windows string, score string")
    made = hard_negatives.mine(df.repartition(3), "vec_id", "vector", "label", F.col("vec_id") % 10 == 0, block_points=block, block_questions=30)
    want = brute_negatives(rows, {k for k, *_ in rows if k is not None and k % 10 == 0})
    assert len(want) > 500 and ordered(made.collect()) == ordered(want)


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, vector array<long>, label int"
    mine = lambda rows, anchor: hard_negatives.mine(spark.createDataFrame(rows, schema), "vec_id", "vector", "label", anchor).count()
    assert mine([], F.lit(True)) == 0 and mine([(1, [1, 2], 0), (2, [1, 2], 1)], F.lit(False)) == 0
    with pytest.raises(Exception, match="squared norm"):
        mine([(1, [1 << 27], 0), (2, [1], 0)], F.lit(True))


def test_the_tree_passes_over_most_points():
    """In clusters the search reads few leaves, and what it finds is exact."""
    points = np.array(vectors(3000, 16, 9, spread=15))
    tree = hard_negatives.CoverTree(points, [i % 3 for i in range(3000)], [[i] for i in range(3000)])
    read = 0
    for q in points[::300]:
        search = tree.search(q)
        scores = points @ q
        top = int(scores.max())
        for low, high in ((-(1 << 60), 1 << 60), (top * 3 // 10, top * 9 // 10), (top // 2, top // 2 + 500)):
            want = sorted((-int(s), i) for i, s in enumerate(scores) if i % 3 == 1 and low <= s <= high)[:10]
            assert [(-s, k) for s, k, _ in search.best(10, True, 1, low, high)] == want
        read += len(search.known)
    inner = sum(k is not None for k in tree.kids)
    assert read < 0.5 * 10 * inner
    for node, kids in enumerate(tree.kids):  # covering
        if kids:
            for k in range(*kids):
                assert tree.radius[k] <= tree.radius[node] + 1e-9


# --- mends ----------------------------------------------------------------------------------------

def test_raking_by_arrays_is_raking_by_tables(spark):
    """Caps that bind on several margins: the same rounds give the same on arrays and on tables."""
    from ticketloom.llm import mixing

    rng = random.Random(2)
    values, other = ["x", "y", None, "z"], ["p", "q", "r"]
    cells = {(a, b): rng.choice([0.0, 5.0, 40.0, 300.0, 2000.0]) for a in values for b in other}
    shares = [dict(zip(values, [0.4, 0.3, 0.2, 0.1])), dict(zip(other, [0.6, 0.3, 0.1]))]
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "_a string, _b string, _tokens double")
    aims = {m: spark.createDataFrame([*own.items()], f"{m} string, _target double") for m, own in zip(("_a", "_b"), shares)}
    tables = {(r._a, r._b): r._probability for r in mixing.filled(df, aims, 0.4, rounds=4).collect()}
    codes = [np.array([v.index(c[i]) for c in cells]) for i, v in enumerate((values, other))]
    targets = [np.array([own[v] for v in names]) for own, names in zip(shares, (values, other))]
    made, _ = mixing.filled_arrays(codes, np.array([*cells.values()]), targets, 0.4, rounds=4)
    assert dict(zip(cells, made.tolist())) == pytest.approx(tables, abs=1e-9)


def test_caps_that_bind_on_two_margins(spark):
    """One small cell is taken whole; what it lacks goes to the others so that both margins hold."""
    from ticketloom.llm import mixing

    cells = {("x", "p"): 10.0, ("x", "q"): 1000.0, ("y", "p"): 1000.0, ("y", "q"): 1000.0}
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "_a string, _b string, _tokens double")
    aims = {m: spark.createDataFrame([(v, 0.5) for v in pair], f"{m} string, _target double") for m, pair in (("_a", "xy"), ("_b", "pq"))}
    made = {(r._a, r._b): r for r in mixing.probabilities(df, aims, 0.4).collect()}
    want = {("x", "p"): 1.0, ("x", "q"): 0.592, ("y", "p"): 0.592, ("y", "q"): 0.01}
    assert {c: r._probability for c, r in made.items()} == pytest.approx(want, abs=1e-4) and made["x", "p"]._margin_error < 1e-4


def test_margins_that_cannot_hold_are_told(spark):
    from ticketloom.llm import mixing

    df = spark.createDataFrame([("x", "p", 100.0), ("y", "q", 100.0)], "_a string, _b string, _tokens double")
    aims = {"_a": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "_a string, _target double"),
            "_b": spark.createDataFrame([("p", 0.1), ("q", 0.9)], "_b string, _target double")}
    assert mixing.probabilities(df, aims, 0.3).first()._margin_error > 0.1
    assert mixing.probabilities(df.limit(0), aims, 0.3).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 1_100_000 + "b c", "x " * 10 + "\t" * 1_000_001, " \n" * 600_000 + "end"])
def test_long_white_space_is_counted_as_the_library_does(text):
    from tokenizers import Tokenizer

    from ticketloom.llm import tokenize
    from ticketloom.llm.queries import TOKENIZER

    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert tokenize.encoder(TOKENIZER).encode(["one two", text])[1].tolist() == want


def test_names_that_operators_use_or_give(spark):
    from ticketloom.llm import substrings, urls

    passage = prose(40)
    names = ["shared", "hot", "stretches", "n_words", "kept_text", "n_removed", "trimmed_text", "minimiser", "packed", "first", "held"]
    rows = [(1, passage, *("x" for _ in names)), (2, "one\n\n" + passage + "\ntwo three", *("x" for _ in names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for hot_rows in (1, 2000):
        found = {r.doc_id: r for r in substrings.dedup(df, hot_rows=hot_rows, trimmed=True).collect()}
        assert found[2].n_removed == 40 and found[2].kept_text == "one two three" and found[2].trimmed_text == "one\ntwo three"
        assert found[1].trimmed_text == passage and found[1].n_words == 40 and found[1].held == found[1].shared == "x"
    captures = spark.createDataFrame([("http://a.com/", None, "x", "y", True)], "url string, fetched_at timestamp_ntz, lists string, pattern string, blocked boolean")
    entries = spark.createDataFrame([], "list string, pattern string, action string, at timestamp_ntz")
    made = urls.filter_captures(captures, entries, ["url", "lists", "pattern", "blocked"], [])
    assert [tuple(r) for r in made.collect()] == [("http://a.com/", "", "", False)]


def test_hot_super_kmers_of_many_kinds(spark):
    """Passages cut at many places, so that super-k-mers of one minimiser differ; every hot limit gives the same."""
    from ticketloom.llm import substrings

    passage = prose(60).split()
    rows = [(i, " ".join([f"own{i}", *passage[i % 17:60 - i % 11], f"{i}end", *passage[:20 + i % 5]])) for i in range(80)]
    rows += [(200 + i, " ".join(["tick tack"] * (10 + i))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted((k, *w) for (k, _), w in zip(rows, brute.without_repeats(rows)))
    for hot_rows in (1, 20, 2000):
        found = substrings.dedup(df, hot_rows=hot_rows).select("doc_id", "n_words", "n_removed", "kept_text")
        assert sorted(map(tuple, found.collect())) == wanted


def test_cut_out():
    import numpy as np

    from ticketloom.llm.substrings import cut_out

    cut = lambda text, gone: cut_out(text.encode(), np.array([c == "x" for c in gone])).decode()
    assert cut("  a b\n\nc\td e ", ".xx..") == "a\nd e"
    assert cut("é  ü ö", "x..") == "ü ö" and cut("a b", "xx") == "" and cut("a\x0b\x0cb c", "..x") == "a\x0b\x0cb"


def test_pieces_of_huge_documents_spread(spark):
    from ticketloom.llm import packing
    from ticketloom.llm.queries import TOKENIZER

    rows = spark.createDataFrame([(i, "word other " * 60_000) for i in range(4)], "doc_id long, text string")
    made = packing.pack(rows, "doc_id", "text", TOKENIZER, pool_rows=20, with_ids=False).collect()
    assert len({r.sequence_id >> 32 for r in made}) > 4 and sum(r.length for r in made) == sum({r.doc_id: r.doc_tokens for r in made}.values())
