"""Every operator on small tables: against brute force, and on nulls, empty and long texts, ties, repeats."""

import datetime as dt
import hashlib
import json
import random
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm import brute
from ticketloom.llm import (
    chat, fingerprints, mixing, near_duplicates, order, packing, quality, sharding, substrings, tokenize, urls,
)
from ticketloom.llm.queries import REGISTRY, TOKENIZER

DRAW = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(DRAW.choices(VOCABULARY, k=n))


PASSAGE, LONG = prose(60), prose(12_000)
EDGES = [
    (1, PASSAGE), (2, prose(30) + "\n" + PASSAGE + "\t" + prose(5)), (3, PASSAGE), (4, None), (5, ""), (6, " \n\t "),
    (7, "one two"), (8, "one two"), (9, LONG), (10, LONG + " end"), (11, LONG.replace("w7 ", "w8 ")), (12, "a " * 300),
    (13, "x y z " * 40), (14, PASSAGE[:-4] + " new end"), (None, prose(40)), (16, "é ü\x0b中\x0cß  |  #"), (17, prose(200)),
]
# Extra columns with the names that the operators use inside themselves, or give.
EXTRA = "source string, lang string, n_chars long, band string, id string, tokens string, slice string, next_text string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def table(spark, rows):
    return spark.createDataFrame([(i, t, f"s{k % 3}", "en" if k % 2 else None, k, "x", "y", "z", "q", "r")
                                  for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- order and shards --------------------------------------------------------------------------

def test_row_numbers(spark, empty):
    rows = [(i * i % 101, f"t{i}") for i in range(300)] + [(None, "n")] * 3
    numbered, total = order.with_row_number(table(spark, rows), "doc_id", ["text"], "n")
    found = [(r.n, r.doc_id, r.text) for r in numbered.orderBy("n").collect()]
    assert total == 303 and [f[0] for f in found] == list(range(303))
    assert [f[1:] for f in found] == sorted(rows, key=lambda r: (r[0] is not None, r))
    assert order.with_row_number(empty, "doc_id", ["text"], "n")[1] == 0


def test_shards(spark, edges, empty):
    made = {r.doc_id: r for r in sharding.shards(edges, count=4).collect()}
    assert len(made) == len(EDGES) and sharding.shards(empty).count() == 0
    base, keys, ranked = sharding.base_of(len(EDGES)), sharding.round_keys(20_240_229), sorted(
        EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    for n, (key, text) in enumerate(ranked):
        place = sharding.permute_once(n, base, keys)
        while place >= len(EDGES):
            place = sharding.permute_once(place, base, keys)
        raw = (text or "").encode()
        assert tuple(made[key]) == (key, len(raw) + 1, crc32(raw), place % 4, place // 4)


def test_repeated_rows_get_slots_of_their_own(spark):
    made = sharding.shards(table(spark, [(1, "a")] * 50 + [(2, "b")] * 50)).collect()
    slots = sorted((r.shard, r.slot) for r in made)
    assert slots == sorted((p % 8, p // 8) for p in range(100))


# --- fingerprints ------------------------------------------------------------------------------

def test_fingerprints_estimate_likeness(spark, edges):
    rows = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(edges).collect()}
    assert rows[1] == rows[3] and rows[7] == rows[8] and rows[4] == rows[5] == rows[6] == []
    assert all(len(v) == 64 for k, v in rows.items() if k not in (4, 5, 6))
    made = fingerprints.fingerprints(edges).select("doc_id", "text", "fingerprint")
    left, right = made.toDF("a", "a_text", "a_print"), made.toDF("b", "b_text", "b_print")
    pairs = left.join(right, F.col("a") <= F.col("b")).withColumn("like", fingerprints.likeness(F.col("a_print"), F.col("b_print")))
    for r in pairs.collect():
        a, b = set(brute.shingles(r.a_text)), set(brute.shingles(r.b_text))
        wanted = 1.0 if not a and not b else len(a & b) / len(a | b)
        assert r.like == pytest.approx(wanted, abs=0.16), (r.a, r.b)
    assert fingerprints.likeness is not None and all(0 <= r.like <= 1 for r in pairs.collect())


def test_empty_bins_are_filled_alike(spark):
    """Short texts fill few bins; the rest still agrees as often as the texts are alike."""
    rows = []
    for i in range(150):
        words = DRAW.sample(VOCABULARY, 24)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:16] + DRAW.sample(VOCABULARY, 8)))]
    made = fingerprints.fingerprints(table(spark, rows)).select((F.col("doc_id") / 2).cast("long").alias("pair"), "doc_id", "fingerprint")
    one, two = made.filter("doc_id % 2 = 0"), made.filter("doc_id % 2 = 1").withColumnRenamed("fingerprint", "other")
    found = one.join(two, "pair").select(fingerprints.likeness(F.col("fingerprint"), F.col("other"))).collect()
    texts = dict(rows)
    wanted = [len(a & b) / len(a | b) for i in range(150)
              for a, b in [(set(brute.shingles(texts[2 * i])), set(brute.shingles(texts[2 * i + 1])))]]
    assert np.mean([r[0] for r in found]) == pytest.approx(np.mean(wanted), abs=0.03)


@pytest.mark.parametrize("rows", [EDGES, [(1, "only")], [(5, "b"), (5, "a"), (5, "a"), (2, "c")], []])
def test_the_next_document(spark, rows):
    df = table(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(3)
    ranked = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = sorted(map(str, [(k, t, ranked[(i + 1) % len(ranked)][1]) for i, (k, t) in enumerate(ranked)]))
    found = fingerprints.with_next(df, "doc_id", ["text"]).select("doc_id", "text", "next_text").collect()
    assert sorted(str(tuple(r)) for r in found) == wanted


def test_edited_texts(spark):
    df = spark.createDataFrame([("abcdefgh", "xyz"), ("abc", "xyz"), ("é中éé" * 2, ""), ("", "q")], "a string, b string")
    found = [r[0] for r in df.select(fingerprints.edited_text(F.col("a"), F.col("b"))).collect()]
    assert found == ["abcdefxy", "abc", "é中éé" + "é中", ""]


# --- substrings --------------------------------------------------------------------------------

@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings(spark, edges, empty, hot):
    wanted = sorted(map(str, ((k, *w) for (k, _), w in zip(EDGES, brute.without_repeats(EDGES)))))
    made = substrings.dedup(edges, hot_rows=hot)
    assert made.columns == [*edges.columns, "kept_text", "n_words", "n_removed"]
    found = made.select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(str(tuple(r)) for r in found) == wanted
    assert substrings.dedup(empty).count() == 0


def test_rows_of_one_key_leave_each_other_alone(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (1, prose(20) + " " + PASSAGE), (2, PASSAGE)]
    found = substrings.dedup(table(spark, rows)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, found)) == [(1, 0), (1, 0), (1, 0), (2, 60)]


# --- near duplicates ---------------------------------------------------------------------------

def family(size, words=200, edits=4):
    """Texts that are all close to the first, and less close to each other."""
    base = DRAW.choices(VOCABULARY, k=words)
    out = [" ".join(base)]
    for _ in range(size - 1):
        copy = base[:]
        for i in DRAW.sample(range(words), edits):
            copy[i] = "new" + str(DRAW.random())
        out.append(" ".join(copy))
    return out


def test_classes(spark, edges, empty):
    texts = [t for size, edits in ((30, 2), (25, 4), (20, 6)) for t in family(size, edits=edits)]
    texts += [prose(100) for _ in range(40)] + [PASSAGE + " " + prose(n) for n in range(5, 60, 5)]
    DRAW.shuffle(texts)
    rows = list(enumerate(texts, 100)) + [r for r in EDGES if r[0] is not None]
    wanted = brute.near_classes(rows)
    found = {r.doc_id: r.class_id for r in near_duplicates.classes(table(spark, rows)).collect()}
    assert found == wanted
    assert near_duplicates.classes(empty).count() == 0
    assert near_duplicates.classes(edges).count() == len(EDGES)


def test_copies_around_a_text_that_are_less_like_each_other(spark):
    """Each is at 0.8 or more from the first text only; the first has neither the least nor the largest key."""
    texts = family(60, words=160, edits=3)
    rows = [(i if k else 1000, t) for k, (i, t) in enumerate(zip(range(970, 1030), texts)) if i != 1000 or not k]
    wanted = brute.near_classes(rows)
    assert len(set(wanted.values())) < 20
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(table(spark, rows)).collect()} == wanted


def test_sketches_agree_where_coordinates_do():
    made = [near_duplicates.signature(*near_duplicates.shingles(t)) for t in family(6, edits=20)]
    packed = np.stack([near_duplicates.sketch_of(m).view(np.uint64) for m in made])
    bits = [(m >> np.uint64(40)) & np.uint64(15) for m in made]
    wanted = [[int((a == b).sum()) for b in bits] for a in bits]
    assert near_duplicates.agreeing(packed, packed).tolist() == wanted


@pytest.mark.parametrize("block", [3, 500])
def test_buckets_of_many_classes(spark, monkeypatch, block):
    """Copies of one text with few or many changes: linked in chains, or not at all."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    base = DRAW.choices(VOCABULARY, k=150)
    texts = []
    for _ in range(60):
        copy = base[:]
        for i in DRAW.sample(range(150), DRAW.randint(1, 8)):
            copy[i] = "new" + str(DRAW.random())
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    wanted = brute.near_classes(rows)
    assert 3 < len(set(wanted.values())) < 60
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(table(spark, rows)).collect()} == wanted


def test_repeated_keys_share_a_class(spark):
    found = near_duplicates.classes(table(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (3, None), (3, None)])).collect()
    assert sorted(map(tuple, found)) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 150), (160, 150), (170, 160)] + [(200, 200 + i) for i in range(1, 50)]
    DRAW.shuffle(chain)
    found = {r["id"]: r["class"] for r in near_duplicates.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {i: found.get(i, i) for i in range(41)} == {i: 0 for i in range(41)}
    assert {found.get(i, i) for i in (100, 150, 160, 170)} == {100} and {found.get(i, i) for i in range(200, 250)} == {200}
    assert near_duplicates.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing and counts ------------------------------------------------------------------------

@pytest.mark.parametrize("with_ids", [True, False])
def test_packing(spark, edges, empty, with_ids):
    rows = EDGES + [(7, "one two")] * 3
    made = packing.pack(table(spark, rows).repartition(2), "doc_id", "text", TOKENIZER, capacity=64, pool_rows=4, with_ids=with_ids)
    pieces = made.collect()
    encode = tokenize.encoder(TOKENIZER).encode
    tokens = {}
    for key, text in rows:
        tokens.setdefault(key, []).append(np.append(encode([text or ""])[0], 1).astype("<u4"))
    for key, docs in tokens.items():
        own = [p for p in pieces if p.doc_id == key]
        assert {p.doc_tokens for p in own} == {len(d) for d in docs}
        assert sum(p.length for p in own) == sum(map(len, docs))
        for p in own:
            ids = docs[0][p.start:p.start + p.length].tobytes()
            assert p.ids_crc32 == crc32(ids) and (not with_ids or bytes(p.ids) == ids)
    held = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert held.get(p.sequence_id, 0) == p.offset
        held[p.sequence_id] = p.offset + p.length
    assert max(held.values()) <= 64
    assert packing.pack(empty, "doc_id", "text", TOKENIZER).count() == 0


def test_token_counts(spark, edges, empty):
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokenize.token_counts(edges, "text", TOKENIZER, ["doc_id"]).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    for key, text in EDGES:
        text = text or ""
        assert found[key] == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert tokenize.token_counts(empty, "text", TOKENIZER, ["doc_id"]).count() == 0


@pytest.mark.parametrize("change", ["prepend", "special"])
def test_long_texts_are_cut_only_for_plain_files(tmp_path, change):
    model = json.loads(Path(TOKENIZER).read_text(encoding="utf-8"))
    if change == "prepend":
        model["normalizer"] = {"type": "Prepend", "prepend": "Q"}
    else:
        last = max(*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"]))
        made = dict(model["added_tokens"][0], id=last + 1, content="x y")
        model["added_tokens"].append(made)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    text = "x y " * 30_000
    ids = tokenize.Encoder(str(path)).encode([text, "short x y"])
    library = Tokenizer.from_file(str(path))
    assert [list(i) for i in ids] == [library.encode(t, add_special_tokens=False).ids for t in (text, "short x y")]


# --- quality -----------------------------------------------------------------------------------

def test_quality(spark, empty):
    good = [" ".join(DRAW.sample(VOCABULARY, 120)) + "." for _ in range(60)]
    junk = [" ".join(w + DRAW.choice(["###", "$$$", "%%%"]) for w in DRAW.sample(VOCABULARY, 120)) for _ in range(12)]
    rows = list(enumerate(good + junk)) + [(100, None), (101, ""), (102, "short one."), (103, "x y z " * 100)]
    df = table(spark, rows)
    measured = quality.measures(df, "text", ["doc_id"])
    for r in measured.collect():
        assert tuple(r)[1:6] == brute.base_measures(dict(rows)[r.doc_id])
    known = quality.fit(measured)
    judged = {r.doc_id: r for r in quality.judge(measured, known).collect()}
    assert {k for k, r in judged.items() if r.kept} == set(range(60))
    assert {k for k, r in judged.items() if r.base_failed} == {100, 101, 102, 103}
    kept = quality.keep_good(df, "text", known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    none = quality.measures(empty, "text", ["doc_id"])
    assert quality.fit(none) == {} and quality.judge(none, {0: 0.5}).count() == 0


# --- chat --------------------------------------------------------------------------------------

def test_chat(spark):
    turns = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] a \\"), (2, 0, "assistant", None), (2, 1, "user", "é"),
             (None, 0, "user", "q"), (None, None, "system", "s"), (3, 0, None, "nobody"), (4, 0, "user", "x"), (4, 0, "user", "x"),
             (5, 0, "user", LONG), (5, 1, "assistant", LONG)]
    df = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn int, role string, text string, segment string, loss int")
    formatted = chat.segments(df.repartition(3), "conv_id", "turn", "role", "text")
    found = {r.conv_id: r for r in chat.read_back(formatted, "conv_id").collect()}
    assert set(found) == {1, 2, None, 3, 4, 5}
    for key, row in found.items():
        own = sorted((t for t in turns if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        said = "".join(x or "" for _, _, r, x in own if r == "assistant")
        assert row.n_turns == len(own) and row.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {k: r.n_illegal_turns for k, r in found.items()} == {1: 0, 2: 1, None: 0, 3: 1, 4: 1, 5: 0}
    assert found[1].formatted_chars == sum(len(r.text) for r in formatted.filter("conv_id = 1").collect())
    assert chat.read_back(chat.segments(df.limit(0), "conv_id", "turn", "role", "text"), "conv_id").count() == 0


# --- mixing ------------------------------------------------------------------------------------

def test_raking(spark):
    cells = {(s, g): DRAW.randint(1, 500) for s in "abcd" for g in ("x", "y", None)}
    targets = [{"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}, {"x": 0.5, "y": 0.3, None: 0.2}]
    df = spark.createDataFrame([(*c, float(t)) for c, t in cells.items()], "_s string, _g string, _tokens double")
    frames = {n: spark.createDataFrame(list(t.items()), f"{n} string, _target double") for n, t in zip(("_s", "_g"), targets)}
    found = {(r._s, r._g): r._weight for r in mixing.rake(df, frames, tolerance=1e-10).collect()}
    wanted = brute.raked(cells, targets)
    assert all(found[c] == pytest.approx(wanted[c], abs=1e-7) for c in cells)


def test_mixing(spark, empty):
    rows = [(i, prose(20 + i % 50) if i % 31 else None) for i in range(600)]
    df = table(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    made = mixing.mix(df, {"source": F.col("source"), "lang": F.col("lang")})
    found = made.select("doc_id", "source", "lang", "_tokens", "_probability", "_sampled").collect()
    assert len(found) == 600 and set(df.columns) <= set(made.columns)
    cells = {}
    for r in found:
        assert r._tokens == len(brute.words(dict(rows)[r.doc_id]))
        cells[r.source, r.lang] = cells.get((r.source, r.lang), 0) + r._tokens
    targets = []
    for m in (0, 1):
        sums = {}
        for c, t in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + t
        raised = {v: t ** mixing.TEMPER for v, t in sums.items()}
        targets.append({v: t / sum(raised.values()) for v, t in raised.items()})
    ratio = {c: w / cells[c] for c, w in brute.raked(cells, targets).items()}
    for r in found:
        assert r._probability == pytest.approx(ratio[r.source, r.lang] / max(ratio.values()), abs=1e-5)
    assert sum(r._sampled for r in found) == pytest.approx(sum(r._probability for r in found), abs=40)
    again = {r.doc_id: r._sampled for r in mixing.mix(df.repartition(5), {"source": F.col("source"), "lang": F.col("lang")}).collect()}
    assert again == {r.doc_id: r._sampled for r in found}
    assert mixing.mix(empty, mixing.default_margins()).count() == 0


def test_mixing_by_share(spark):
    """The share decides the scale: one document of a new source and language moves the others by a thousandth at most."""
    langs = {0: "en", 1: "en", 2: "en", 3: "de", 4: "fr"}
    rows = [(i, prose(20 + i % 50), f"s{(i % 11) ** 2 % 7}", langs[i % 5]) for i in range(1500)]
    columns = "doc_id long, text string, source string, lang string"
    margins = {"source": F.col("source"), "lang": F.col("lang")}

    def run(rows, **scale):
        made = mixing.mix(spark.createDataFrame(rows, columns), margins, **scale).collect()
        return {r.doc_id: r for r in made}

    found, more = run(rows, share=0.75), run([*rows, (-1, prose(5), None, "xx")], share=0.75)
    total = sum(r._tokens for r in found.values())
    assert sum(r._tokens * r._probability for r in found.values()) == pytest.approx(0.75 * total, rel=1e-4)
    assert more[-1]._probability == 1.0 and len(found) == len(rows)
    assert all(more[i]._probability == pytest.approx(r._probability, rel=1e-3) for i, r in found.items())
    for m in margins:  # every target that the supply allows is met
        own, drawn = {}, {}
        for r in found.values():
            own[r[m]] = own.get(r[m], 0) + r._tokens
            drawn[r[m]] = drawn.get(r[m], 0) + r._tokens * r._probability
        raised = {v: t ** mixing.TEMPER for v, t in own.items()}
        for v, t in raised.items():
            assert drawn[v] == pytest.approx(0.75 * total * t / sum(raised.values()), rel=1e-3)
    kept = sum(r._tokens * r._probability for r in run([*rows, (-1, prose(5), None, "xx")]).values())
    assert kept < 0.7 * total  # where the scarcest cell decides, it drops more


def test_mixing_weighs_tokens(spark):
    """Weights are the library's tokens of whole texts, also where there is no white space."""
    texts = ["word " * 30, "Straßenbahnhaltestelle " * 30, "長" * 500, "", None, "a" * 40_000 + " b"] * 20
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(df, {"source": F.col("source")}, share=0.6, tokenizer=TOKENIZER, keep=["doc_id"])
    assert {"doc_id", "_tokens", "_probability", "_sampled"} <= set(made.columns) and "text" not in made.columns
    found = {r.doc_id: r for r in made.collect()}
    library = Tokenizer.from_file(TOKENIZER)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
    assert {i: r._tokens for i, r in found.items()} == want
    total = sum(want.values())
    assert sum(r._tokens * r._probability for r in found.values()) == pytest.approx(0.6 * total, rel=1e-4)
    whole = mixing.mix(df, {"source": F.col("source")}, share=0.6, tokenizer=TOKENIZER)
    assert {(r.doc_id, r.text, r._sampled) for r in whole.collect()} == {(i, t, found[i]._sampled) for i, t, _ in rows}


def test_source_mix_publishes_tokens(spark):
    library, rows = Tokenizer.from_file(TOKENIZER), REGISTRY["op10_source_mix"](spark, SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.tokens for r in rows} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_amounts_go_no_further_than_supply(spark):
    cells = spark.createDataFrame([("a", 10.0), ("b", 100.0), ("c", 890.0), (None, 0.0)], "_s string, _tokens double")
    aims = spark.createDataFrame([("a", 0.4), ("b", 0.2), ("c", 0.4)], "_s string, _target double")
    made = {r._value: r._amount for r in mixing.amounts(cells, {"_s": aims}, 0.5)["_s"].collect()}
    assert made == pytest.approx({"a": 10.0, "b": 100.0, "c": 390.0})
    found = {r._s: r._probability for r in mixing.filled(cells, {"_s": aims}, 0.5).collect()}
    assert found == pytest.approx({"a": 1.0, "b": 1.0, "c": 390 / 890, None: 1.0})


# --- URLs --------------------------------------------------------------------------------------

def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_url_patterns_keep_the_case_of_paths(spark):
    patterns = ["Example.com/De/", "example.com/de/low/", "host.com/A.html", "host.com/b?Q=1", "root.com/"]
    lists = spark.createDataFrame([("spam", p, "add", day(0)) for p in patterns], "list string, pattern string, action string, at timestamp_ntz")
    urls_of = {
        "http://example.com/De/x": "example.com/De/", "http://EXAMPLE.com/de/x": "", "http://example.com/de/low/x": "example.com/de/low/",
        "http://HOST.com/A.html": "host.com/A.html", "http://host.com/A.html?x#f": "host.com/A.html", "http://host.com/a.html": "",
        "http://host.com/A.html/x": "", "http://host.com/b?Q=1#f": "host.com/b?Q=1", "http://host.com/b?q=1": "", "http://host.com/b": "",
        "http://root.com/": "root.com/", "http://root.com/x/y": "root.com/", "http://root.com/x": "root.com/",
    }
    rows = spark.createDataFrame([(u, day(1)) for u in urls_of], "url string, fetched_at timestamp_ntz")
    found = urls.filter_captures(rows, lists, ["url"], []).collect()
    assert {r.url: r.pattern for r in found} == urls_of and {r.url for r in found if r.blocked} == {u for u, p in urls_of.items() if p}


def test_near_duplicates_refuse_a_lower_threshold(spark):
    with pytest.raises(ValueError, match="below 0.8"):
        near_duplicates.classes(table(spark, [(1, PASSAGE)]), threshold=0.6)


def test_url_filters(spark):
    entries = [("spam", "bad.com", "add", day(5)), ("spam", "bad.com", "remove", day(10)), ("spam", "bad.com", "add", day(12)),
               ("spam", "bad.com", "add", day(5)), ("adult", "ok.org/x/", "add", day(0)), ("allow", "good.bad.com", "add", day(0)),
               ("spam", "tie.net", "add", day(3)), ("spam", "tie.net", "remove", day(3)), (None, "n.com", "add", day(0)),
               ("spam", "BAD2.com", "add", day(0))]
    captures = [
        (1, "http://bad.com/", day(4)), (2, "http://bad.com/", day(5)), (3, "https://WWW.Bad.com:80/a?q#f", day(9)),
        (4, "http://bad.com", day(10)), (5, "http://u@bad.com./z", day(12)), (6, "http://notbad.com/", day(6)),
        (7, "http://ok.org/x/y.html", day(1)), (8, "http://ok.org/xx/y", day(1)), (9, "http://good.bad.com/", day(6)),
        (10, None, day(6)), (11, "no url", day(6)), (12, "http://bad.com/", None), (13, "http://tie.net/", day(3)),
        (14, "http://bad2.com/", day(1)), (14, "http://bad2.com/", day(1)), (15, "", day(1)),
    ]
    lists = spark.createDataFrame(entries, "list string, pattern string, action string, at timestamp_ntz")
    rows = spark.createDataFrame([(*c, "x", "y") for c in captures], "page_id long, url string, fetched_at timestamp_ntz, pattern string, lists string")
    found = urls.filter_captures(rows, lists, ["page_id"], ["allow"]).collect()
    assert sorted((r.page_id, r.blocked) for r in found) == sorted(
        (c[0], c[0] in (2, 3, 5, 7, 14)) for c in captures
    )
    by_id = {r.page_id: r for r in found}
    assert (by_id[7].lists, by_id[7].pattern) == ("adult", "ok.org/x/") and by_id[9].lists == "allow,spam"
    assert urls.filter_captures(rows.limit(0), lists, ["page_id"], []).count() == 0
    assert urls.filter_captures(rows, lists.limit(0), ["page_id"], []).filter("blocked").count() == 0
