"""Column expressions over text. All are built-ins, so they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom import fixed_values as V

# Character classes spelled out so that they mean the same in every regex engine.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def remove_all(c: Column, literals: list[str]) -> Column:
    """Remove each literal, in order."""
    return reduce(lambda out, x: F.replace(out, F.lit(x), F.lit("")), literals, c)


def clean_spaced(c: Column) -> Column:
    """Lower case; every run of anything but a-z and 0-9 becomes one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def clean_words(c: Column, compat: bool = False) -> Column:
    """Lower case, ``can't`` and ``can t`` to ``cannot``, punctuation deleted; null is ``nan``.

    ``compat`` replaces ``can t`` inside longer words too (``scan the`` becomes ``scannothe``).
    """
    text = F.replace(F.lower(F.coalesce(c, F.lit("nan"))), F.lit("can't"), F.lit("cannot"))
    if compat:
        text = F.replace(text, F.lit("can t"), F.lit("cannot"))
    else:
        text = F.regexp_replace(text, f"(?<![{WORD}])can t(?![{WORD}])", "cannot")
    return F.regexp_replace(text, f"[^{WORD}{SPACE}]+", "")


def clean_stripped(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space deleted; null is ``nan``."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit("nan"))), f"[^a-z0-9{SPACE}]+", "")


def letter_tokens(c: Column) -> Column:
    """Lower-case a-z tokens, contractions split in two, as ``array<string>``."""
    letters = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^a-z{SPACE}]+", "")
    heads = "|".join(rf"{head}(?={tail}\b)" for head, tail in V.CONTRACTIONS.values())
    spaced = F.regexp_replace(letters, rf"\b({heads})", "$1 ")
    return F.filter(F.split(spaced, f"[{SPACE}]+"), lambda t: t != "")


def text_lengths(c: Column) -> tuple[Column, Column]:
    """Characters and words of a text that ``clean_spaced`` produced."""
    chars = F.length(c)
    words = F.when(c == "", 0).otherwise(chars - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)
    return chars, words


def keyword_count(c: Column, keywords: list[str] | None = None) -> Column:
    """How many of the keywords occur as a substring, each counted once."""
    flags = [F.contains(c, F.lit(k)).cast("int") for k in keywords or V.BUG_KEYWORDS]
    return reduce(lambda a, b: a + b, flags)


def romanised_flag(c: Column, words: list[str] | None = None) -> Column:
    """Does any of the words occur as a whole word?"""
    options = "|".join(words or V.ROMANISED_WORDS)
    return F.coalesce(F.lower(c).rlike(f"(^|[^{WORD}])({options})($|[^{WORD}])"), F.lit(False))


def version_key(c: Column) -> Column:
    """Text key whose plain order is natural version order; alphabetic parts follow numbers.

    A number is written as its digit count and its digits, so ``1.10`` follows ``1.9``.
    """

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(p.rlike("^[0-9]+$"), number).otherwise(F.concat(F.lit("1"), F.lower(p)))

    parts = F.filter(F.split(c, f"[.{SPACE}]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, part), ".")


def sentiment_bucket(c: Column) -> Column:
    """Half-open buckets; the lowest edge and anything outside give null."""
    edges, labels = V.SENTIMENT_EDGES, V.SENTIMENT_LABELS
    out = F.when(c <= edges[0], None)
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= upper, label)
    return out


def priority_rank(c: Column) -> Column:
    """0 for the most urgent level; null for an unknown word."""
    out = F.when(c == V.PRIORITIES[0], 0)
    for i, level in enumerate(V.PRIORITIES[1:], 1):
        out = out.when(c == level, i)
    return out


def markdown_clean(c: Column) -> Column:
    """Drop heading remnants and trim; null is empty."""
    return strip(remove_all(F.coalesce(c, F.lit("")), V.MARKDOWN_REMNANTS))


def drop_labels(c: Column) -> Column:
    """Drop a section label at the start of any line."""
    labels = "|".join(V.REPORT_LABELS)
    return strip(F.regexp_replace(c, rf"(?imd)^[{SPACE}]*[\"']?({labels}):\**[{SPACE}]*", ""))


def report_text(c: Column) -> Column:
    return drop_labels(markdown_clean(c))


def bullets(c: Column) -> Column:
    """Items of a list-like text: the first delimiter that applies splits it; empties dropped."""
    text = markdown_clean(c)

    def occurrences(ch: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))

    pieces = (
        F.when(F.contains(text, F.lit("\n-")), F.split(text, "\n-"))
        .when(F.contains(text, F.lit("\n")), F.split(text, "\n"))
        .when(occurrences("-") > 1, F.split(text, "-"))
        .when(occurrences(".") > 2, F.split(text, "[.]"))
        .otherwise(F.array(text))
    )
    cleaned = F.transform(pieces, lambda p: F.ltrim(strip(p), F.lit(V.BULLET_LEAD)))
    return F.filter(cleaned, lambda p: p != "")


def missing_as_nan(c: Column) -> Column:
    """Text of a value, with a missing one written as the word ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))
