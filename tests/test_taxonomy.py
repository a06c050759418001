"""Longest whole-word keyword, and the two ways to find it."""

import re

import pytest
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom import schemas as S
from ticketloom.operators import taxonomy
from ticketloom.operators.lookup import severity_table, small_table, taxonomy_rules

CASES = [
    ("it crashes a lot", "Other"),
    ("it will crash", "Crash/Freeze"),
    ("cannot access my account", "Login Error"),
    ("slow loading after update", "Slow Performance"),
    ("server down 503", "Server Error"),
    ("payment failed credit card error", "Payment Issue"),
    ("the verification page", "OTP Issue"),
    ("fail", "Payment Issue"),
    ("error oops something went wrong today", "Login Error"),
    ("I can't change contact details!", "Contact Change Issue"),
    ("my password", "Login Error"),
    ("", "Other"),
    (None, "Other"),
    ("can t can t can t log in", "Login Error"),
    ("payment not working payment", "Payment Issue"),
]


def categories(spark, rules, **options):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    return [r.bug_category for r in taxonomy.categorize(df, "text", rules, **options).orderBy("i").collect()]


def test_categories(spark):
    assert categories(spark, taxonomy_rules(spark)) == [c for _, c in CASES]


def test_compat_hides_two_rules_and_joins_words(spark):
    found = categories(spark, taxonomy_rules(spark, compat=True))
    assert found[[t for t, _ in CASES].index("my password")] == "Other"
    df = spark.createDataFrame([("scan the sync",), ("scan the thing",)], "text string")
    rows = taxonomy.categorize(df, "text", taxonomy_rules(spark), compat=True).collect()
    assert [r.bug_category for r in rows] == ["Data Sync Issue", "Other"]


def test_a_large_taxonomy_is_joined_with_the_same_result(spark):
    rules = [(i, c, k) for i, (c, k) in enumerate((c, k) for c, ks in V.TAXONOMY.items() for k in ks)]
    filler = [(1000 + i, "Filler", f"zq{i} word") for i in range(1500)]
    large = small_table(spark, rules + filler, S.TAXONOMY_RULES)
    assert categories(spark, large) == [c for _, c in CASES]
    df = spark.createDataFrame([("a zq7 word here",)] * 3, "text string")
    assert [r.bug_category for r in taxonomy.categorize(df, "text", large).collect()] == ["Filler"] * 3


def test_anchors_find_what_the_inlined_taxonomy_finds(spark):
    """Keywords that overlap, repeat words, share anchors and end at the borders of texts."""
    import random

    draw = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    made = {" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(120)} | {"w1 w1 w1", "never seen", "w2 unseen"}
    rules = small_table(spark, [(i, f"C{i % 9}", k) for i, k in enumerate(sorted(made))], S.TAXONOMY_RULES)
    texts = [" ".join(draw.choices(words + ["other"] * 40, k=draw.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:50], None, "", "w1 w1 w1 w1"])), "i int, text string")
    small = taxonomy.categorize(df, "text", rules).orderBy("i").collect()
    assert taxonomy.categorize(df, "text", rules, inline_rows=0).orderBy("i").collect() == small
    none = taxonomy.categorize(df.limit(0), "text", rules, inline_rows=0)
    assert none.count() == 0 and none.columns == ["i", "text", "bug_category"]


def test_anchors_explode_few_places(spark):
    texts = spark.createDataFrame(
        [(str(i), ("the app is slow and the page " * 20 + f"error{i} now").split(" ")) for i in range(50)],
        "_text_key string, _words array<string>",
    )
    rules = small_table(spark, [(i, "A", f"the app error{i} now") for i in range(2000)], S.TAXONOMY_RULES)
    index = taxonomy.anchors(texts, rules, 15)
    assert {(r.word, r._at) for r in index.collect()} == {(f"error{i}", 2) for i in range(50)}
    places = taxonomy.anchored_places(texts, index, 4, 15)
    every = texts.agg(F.sum(F.size("_words"))).first()[0]
    assert 50 <= places.count() <= every // 10
    assert all(len(r._near) <= 7 for r in places.collect())


def test_rules_are_cleaned_like_texts(spark):
    rules = small_table(spark, [(0, "A", "Won't Start"), (1, "B", "won t start"), (2, "C", "start")], S.TAXONOMY_RULES)
    df = spark.createDataFrame([("it won't start",), ("start",)], "text string")
    assert [r.bug_category for r in taxonomy.categorize(df, "text", rules).collect()] == ["A", "C"]
    none = rules.filter("pos > 5")
    assert [r.bug_category for r in taxonomy.categorize(df, "text", none).collect()] == ["Other"] * 2


def brute_force(text):
    """Every keyword against the text, as the rule is stated."""
    best = ("Other", 0)
    for category, keywords in V.TAXONOMY.items():
        for keyword in keywords:
            if re.search(rf"\b{re.escape(keyword)}\b", text) and len(keyword) > best[1]:
                best = (category, len(keyword))
    return best[0]


def test_against_brute_force_on_mixed_words(spark):
    import random

    draw = random.Random(7)
    vocabulary = sorted({w for ks in V.TAXONOMY.values() for k in ks for w in k.split()} | {"the", "my", "is"})
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 12))) for _ in range(800)]
    texts = [t for t in texts if "can t" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = taxonomy.categorize(df, "text", taxonomy_rules(spark)).orderBy("i").collect()
    assert [r.bug_category for r in found] == [brute_force(t) for t in texts]


def test_severity_default(spark):
    df = spark.createDataFrame([("OTP Issue",), ("New",), (None,)], "bug_category string")
    rows = taxonomy.with_severity(df, severity_table(spark)).collect()
    assert {(r.bug_category, r.syslog_level, r.severity_code) for r in rows} == {
        ("OTP Issue", "warning", 4), ("New", "debug", 7), (None, "debug", 7),
    }


def test_taxonomy_size_and_split(spark):
    assert sum(len(ks) for ks in V.TAXONOMY.values()) <= 200
    df = spark.createDataFrame([("other",), ("Other",), ("UI Issue",)], "bug_category string")
    labelled, other = taxonomy.split_other(df)
    assert (labelled.count(), other.count()) == (1, 2)


@pytest.mark.parametrize("text,expected", [("cannot connect account", "Server Error")])
def test_equal_length_goes_to_the_earlier_category(spark, text, expected):
    # "cannot connect" (14) beats "account" (7)
    df = spark.createDataFrame([(text,)], "text string")
    found = taxonomy.categorize(df, "text", taxonomy_rules(spark))
    assert found.select(F.first("bug_category")).first()[0] == expected


def test_a_large_taxonomy_makes_no_more_rows_than_texts_have_runs(spark):
    """2,000 keywords that share both their words' place and their rarest word: each run meets one of them."""
    texts = spark.createDataFrame([(str(i), f"slow app page{i % 7} slow app".split(" ")) for i in range(40)], "_text_key string, _words array<string>")
    rules = small_table(spark, [(i, "A", f"slow app page{i}") for i in range(2000)], S.TAXONOMY_RULES)
    met = taxonomy.keyword_hits(texts, rules, [1, 3], 20).join(rules, "keyword")
    assert sorted(r.keyword for r in met.collect()) == sorted(f"slow app page{i % 7}" for i in range(40))
    shared = small_table(spark, [(i, f"C{i % 5}", f"slow{i} app") for i in range(2000)] + [(9000, "Z", "app")], S.TAXONOMY_RULES)
    df = spark.createDataFrame([(f"the slow{i} app" if i % 2 else "an app",) for i in range(100)], "text string")
    found = taxonomy.categorize(df, "text", shared, inline_rows=0).select("text", "bug_category").distinct()
    assert {(r.text, r.bug_category) for r in found.collect()} == {("an app", "Z")} | {(f"the slow{i} app", f"C{i % 5}") for i in range(1, 100, 2)}
