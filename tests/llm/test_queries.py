"""The registered queries and the pipeline over a whole small table, against brute force."""

import hashlib
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import brute
from ticketloom.llm import mixing, near_duplicates, quality, tokenize
from ticketloom.llm.oracles import oracle_sql
from ticketloom.llm.queries import ALLOW_LISTS, REGISTRY, TOKENIZER
from tools.check_oracle import TABLES, canonical


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    return sorted(rows, key=lambda r: r.doc_id)


def by_id(spark, name):
    return {r.doc_id: r for r in REGISTRY[name](spark, SMALL).collect()}


def test_every_operator_has_a_query():
    assert [int(n.split("_")[0][2:]) for n in sorted(REGISTRY, key=lambda n: int(n.split("_")[0][2:]))] == list(range(1, 14))
    assert {*REGISTRY, "pipeline"} <= set(entry_module.queries()) and len(ALLOW_LISTS) == 1


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, want = REGISTRY[name](spark, SMALL), duck.execute(oracle_sql()[name]).df()
    assert sorted(df.columns) == sorted(want.columns) and canonical(df.toPandas()) == canonical(want)


@pytest.mark.parametrize("name", ["op1_fingerprints", "op9_shards"])
def test_native_plans(spark, name):
    plan = REGISTRY[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"):
        assert word not in plan


def test_fingerprints(spark, documents):
    found = by_id(spark, "op1_fingerprints")
    texts = [d.text or "" for d in documents]
    errors = []
    for i, d in enumerate(documents):
        text, following, row = texts[i], texts[(i + 1) % len(texts)], found[d.doc_id]
        edited = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((row.near_edited, edited), (row.near_next, following)):
            a, b = set(brute.shingles(text)), set(brute.shingles(other))
            errors.append(got - (len(a & b) / len(a | b) if a or b else 1.0))
    assert np.abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.17
    prints = {}
    for d in documents:
        assert prints.setdefault(d.text, found[d.doc_id].fingerprint) == found[d.doc_id].fingerprint


def test_substrings(spark, documents):
    found = by_id(spark, "op2_substring_dedup")
    for d, (n, removed, kept) in zip(documents, brute.without_repeats([(d.doc_id, d.text) for d in documents])):
        assert tuple(found[d.doc_id]) == (d.doc_id, n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_packing_and_counts(spark, documents):
    ids = tokenize.encoder(TOKENIZER).encode([d.text or "" for d in documents])
    pieces = REGISTRY["op4_packing"](spark, SMALL).collect()
    counts = by_id(spark, "op8_token_counts")
    held, own = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert held.get(p.sequence_id, 0) == p.offset
        held[p.sequence_id] = p.offset + p.length
        own.setdefault(p.doc_id, []).append(p)
    assert max(held.values()) <= 2048 and sum(2048 - n for n in held.values()) < 2048
    for d, tokens in zip(documents, ids):
        whole, at = np.append(tokens, 1).astype("<u4"), 0
        for p in sorted(own[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc32(whole[at:at + p.length].tobytes()) and p.doc_tokens == len(whole)
            at += p.length
        assert at == len(whole)
        c = counts[d.doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len((d.text or "").encode()), len(tokens), len(tokens) > 512)


def test_quality(spark, documents):
    found = by_id(spark, "op5_quality_rules")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for d in documents:
        row, base = found[d.doc_id], brute.base_measures(d.text)
        assert tuple(row)[1:6] == base
        assert row.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        if not row.base_failed and d.doc_id in labels:
            assert row.kept == bool(labels[d.doc_id])
        assert not (row.base_failed and row.kept)


def test_near_duplicates(spark, documents):
    found = {i: r.class_id for i, r in by_id(spark, "op6_near_duplicates").items()}
    assert found == brute.near_classes([(d.doc_id, d.text) for d in documents])


def test_pipeline(spark, documents):
    """Each stage on what the one before it kept."""
    docs = spark.createDataFrame(documents, spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    columns, rows = docs.columns, {d.doc_id: d for d in documents}
    stages = dict(corpus_pipeline.STAGES)
    kept = [stages[name] for name in ("quality_rules", "near_dedup", "substring_dedup", "source_mix", "packing")]

    def run(stage, rows):
        frame = spark.createDataFrame(list(rows.values()), docs.schema)
        made = stage(spark, frame, SMALL)
        assert made.columns == columns
        return {r.doc_id: r for r in made.collect()}

    good = run(kept[0], rows)
    known = quality.fit(quality.measures(docs, "text", []))
    verdicts = {}
    for i, d in rows.items():
        m = quality.measure(d.text)
        arrays = {k: np.array([v]) for k, v in zip(quality.MEASURES, m)}
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        verdicts[i] = not failed and known[int(quality.pattern_of(arrays, quality.RULES)[0])] >= 0.5
    assert good == {i: d for i, d in rows.items() if verdicts[i]}

    single = run(kept[1], good)
    classes = brute.near_classes([(i, d.text) for i, d in good.items()])
    assert single == {i: d for i, d in good.items() if classes[i] == i}

    unique = run(kept[2], single)
    for (i, d), (n, removed, text) in zip(sorted(single.items()), brute.without_repeats([(i, single[i].text) for i in sorted(single)])):
        if removed == n:
            assert i not in unique
        else:
            assert " ".join(unique[i].text.encode().decode().split()) == " ".join(text.split()) if removed else unique[i].text == d.text
            assert unique[i].n_chars == (len(unique[i].text) if removed else d.n_chars)

    frame = spark.createDataFrame(list(unique.values()), docs.schema)
    mixed = run(kept[3], unique)
    drawn = {r[0]: (r[1], r[2]) for r in frame.select(
        "doc_id", mixing.draw("doc_id", "text", 97), mixing.topic_of(F.col("text"))).collect()}
    cells, library = {}, Tokenizer.from_file(TOKENIZER)
    for i, d in unique.items():
        cell = (d.source, d.lang, drawn[i][1])
        cells[cell] = cells.get(cell, 0) + len(library.encode(d.text, add_special_tokens=False).ids)
    targets = []
    for m in range(3):
        sums = {}
        for c, t in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + t
        raised = {v: t ** mixing.TEMPER for v, t in sums.items()}
        targets.append({v: t / sum(raised.values()) for v, t in raised.items()})
    taken = brute.capped(cells, targets, mixing.SHARE)
    for i, d in unique.items():
        p = taken[d.source, d.lang, drawn[i][1]] / cells[d.source, d.lang, drawn[i][1]]
        if abs(drawn[i][0] - p) > 1e-3:
            assert (i in mixed) == (drawn[i][0] < p)

    packed = kept[4](spark, spark.createDataFrame(list(mixed.values()), docs.schema), SMALL).collect()
    ids = dict(zip(mixed, tokenize.encoder(TOKENIZER).encode([d.text or "" for d in mixed.values()])))
    assert {p.doc_id: p.doc_tokens for p in packed} == {i: len(t) + 1 for i, t in ids.items()}
    for i, own in ids.items():  # the ids themselves, in order
        found = b"".join(bytes(p.ids) for p in sorted(packed, key=lambda p: p.start) if p.doc_id == i)
        assert found == np.append(own, 1).astype("<u4").tobytes()
    assert near_duplicates.THRESHOLD == 0.8


def test_pipeline_runs_whole(spark):
    made = entry_module.queries()["pipeline"](spark, SMALL)
    assert made.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(made.columns)


def test_pipeline_stages_on_odd_rows(spark):
    """Rows that share an id, equal rows, nulls, empty and long texts, clashing columns: nothing clean is lost."""
    rng = __import__("random").Random(4)
    prose = lambda n: " ".join("".join(rng.choices("aeioutnrsl", k=rng.randint(3, 9))) for _ in range(n)) + "."
    a, b, c, long = prose(80), prose(90), prose(70), prose(30_000)
    rows = [(1, a), (5, a), (5, b), (7, b + " q"), (9, c), (9, c), (None, prose(60)), (11, None), (12, ""), (13, long), (14, long), (15, " " * 50)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, shared string, hot string, band string, id string"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", "x", "y", "z") for i, t in rows], columns)
    stages = dict(corpus_pipeline.STAGES)
    for n, stage in stages.items():
        assert stage(spark, df.limit(0), SMALL).count() == 0, n
    single = [(r.doc_id, r.text) for r in stages["near_dedup"](spark, df, SMALL).collect()]
    assert sorted(map(repr, single)) == sorted(map(repr, [(1, a), (5, b), (9, c), rows[6], (11, None), (12, ""), (13, long), (15, " " * 50)]))
    unique = stages["substring_dedup"](spark, df, SMALL)
    assert unique.columns == df.columns and {(5, b), (1, a), (9, c), (13, long), (12, ""), (11, None)} <= {(r.doc_id, r.text) for r in unique.collect()}
    mixed = stages["source_mix"](spark, df, SMALL)
    assert mixed.columns == df.columns and mixed.count() <= len(rows)
    good = stages["quality_rules"](spark, df, SMALL)
    assert good.columns == df.columns and not {11, 12, 15} & {r.doc_id for r in good.collect()}
    pieces = stages["packing"](spark, df, SMALL).collect()
    assert sum(p.length for p in pieces) == sum(len(bytes(p.ids)) // 4 for p in pieces) and {p.doc_id for p in pieces} == {i for i, _ in rows}
