"""Text expressions against results worked out by hand."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticketloom.functions import text as X


def test_clean_spaced(column):
    texts = [None, "", "Can't  LOG-in!! 5/5 now", "  ok ", "ශ්‍රී app é", "\u000b\t"]
    assert column(X.clean_spaced, texts) == ["", "", "can t log in 5 5 now", "ok", "app", ""]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_cleaners_are_idempotent(column, texts):
    texts = [t.replace("\x00", " ").encode("utf-8", "ignore").decode() for t in texts]
    for cleaner in (X.clean_spaced, X.clean_words, X.clean_stripped):
        once = column(cleaner, texts)
        assert column(cleaner, once) == once


def test_clean_words(column):
    texts = ["I can't, really", "we can t log", "scan the code", None, "été_1 (ok)"]
    assert column(X.clean_words, texts) == [
        "i cannot really", "we cannot log", "scan the code", "nan", "été_1 ok",
    ]
    compat = column(lambda c: X.clean_words(c, compat=True), texts)
    assert compat[2] == "scannothe code"


def test_clean_stripped_deletes(column):
    assert column(X.clean_stripped, ["Log-in é 5!", None]) == ["login  5", "nan"]


def test_letter_tokens_split_contractions(column):
    texts = ["I cannot log-in 2 times", "wanna gotta cannots", None, "  "]
    assert column(X.letter_tokens, texts) == [
        ["i", "can", "not", "login", "times"], ["wan", "na", "got", "ta", "cannots"], [], [],
    ]


def test_text_lengths(column):
    texts = ["", "a", "app is slow"]
    assert column(lambda c: X.text_lengths(c)[0], texts) == [0, 1, 11]
    assert column(lambda c: X.text_lengths(c)[1], texts) == [0, 1, 3]


def test_keywords_are_substrings_counted_once(column):
    texts = ["crashes and crash", "prefix debugging", "not working fixed issue", ""]
    assert column(X.keyword_count, texts) == [1, 2, 3, 0]


def test_romanised_words_are_whole(column):
    texts = ["App eka WADA nehe", "wadaya", "x.nhe!", None]
    assert column(X.romanised_flag, texts) == [True, False, True, False]


def test_version_order(column):
    versions = ["2.0", "1.x", "1.9.2", "1.10.0", "1.9", "1.009.10", "beta"]
    keys = column(X.version_key, versions)
    order = [v for _, v in sorted(zip(keys, versions))]
    assert order == ["1.9", "1.9.2", "1.009.10", "1.10.0", "1.x", "2.0", "beta"]


def test_sentiment_bucket_edges(column):
    scores = [-1.0, -0.99, -0.3, -0.29, 0.3, 0.31, 1.0, 1.1, None]
    assert column(X.sentiment_bucket, scores, "double") == [
        None, "Negative", "Negative", "Neutral", "Neutral", "Positive", "Positive", None, None,
    ]


def test_priority_rank(column):
    assert column(X.priority_rank, ["Critical", "Unknown", "Low\nand more", None]) == [0, 4, None, None]


def test_report_text(column):
    texts = [
        "### 1. SUMMARY: it fails", "a\n  \"Key Findings:** b", "****", None,
        "x SUMMARY: stays", "priority level: \n high",
    ]
    assert column(X.report_text, texts) == ["it fails", "a\nb", "", "", "x SUMMARY: stays", "high"]


def test_bullets_first_rule_wins(column):
    texts = [
        "intro\n- one - two\n- three", "l1\n\n 2. l2 ", "- a - b - c", "One. Two. Three. ",
        "just one-off", "", None, "• ✓ dot",
    ]
    assert column(X.bullets, texts) == [
        ["intro", "one - two", "three"], ["l1", "l2"], ["a", "b", "c"], ["One", "Two", "Three"],
        ["just one-off"], [], [], ["dot"],
    ]
