"""Keyword taxonomy: the longest keyword that occurs as whole words decides the category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom.functions import text as X
from ticketloom.functions.membership import may_hold, member_bits, power_for
from ticketloom.operators.lookup import INLINE_ROWS, bounded_rows, unique
from ticketloom.session import materialise


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Clean the keywords as the texts are cleaned; of equal keywords the first position wins."""
    keyword = X.clean_words(X.clean_spaced(F.col("keyword")))
    return (
        rules.select("pos", "category", keyword.alias("keyword"))
        .filter("keyword <> ''")
        .groupBy("keyword")
        .agg(F.min("pos").alias("pos"), F.min_by("category", "pos").alias("category"))
    )


def padded_words(text: Column, compat: bool = False) -> Column:
    """``clean_spaced`` text as ``clean_words`` leaves it, between two spaces.

    Such text has no punctuation left, so only ``can t`` has to be replaced. Literal replacement
    skips every second one of a run, hence twice.
    """
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    if compat:
        return F.replace(padded, F.lit("can t"), F.lit("cannot"))
    for _ in range(2):
        padded = F.replace(padded, F.lit(" can t "), F.lit(" cannot "))
    return padded


def categorize(
    df: DataFrame, col: str, rules: DataFrame, default: str = V.DEFAULT_CATEGORY,
    compat: bool = False, cleaned: bool = False, inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Add ``bug_category`` for the text in ``col`` by ``rules(pos, category, keyword)``.

    A taxonomy that passes the size check is inlined: no shuffle, no join, one pass over the text.
    One of more than ``inline_rows`` keywords is joined by whole keywords. ``cleaned`` says that
    ``clean_spaced`` made the text.
    """
    rules = normalise_rules(rules)
    padded = padded_words(F.col(col) if cleaned else X.clean_spaced(F.col(col)), compat)
    small = bounded_rows(rules, inline_rows)
    if small is None:
        return _categorize_by_runs(df, F.trim(padded), rules, default)
    if not small:
        return df.withColumn("bug_category", F.lit(default))
    ordered = sorted(small, key=lambda r: (-len(r.keyword), r.pos))
    keywords = F.array(*[F.lit(r.keyword) for r in ordered])
    categories = F.array(*[F.lit(r.category) for r in ordered])
    pattern = F.lit(_keyword_pattern([r.keyword for r in ordered]))
    found = df.withColumn("_found", F.regexp_extract_all(padded, pattern))
    rank = _first_rank(keywords, F.col("_found"))
    category = F.coalesce(F.get(categories, (rank - 1).cast("int")), F.lit(default))
    return found.withColumn("bug_category", category).drop("_found")


def _first_rank(ordered: Column, found: Column, few: int = 4) -> Column:
    """Smallest 1-based place in ``ordered`` of any of the ``found`` words; null if there is none.

    Most texts hold few keywords, which are looked up one by one. For any more, the intersection
    keeps the order of its first array. Both stay in generated code, which a lambda would leave.
    """
    places = [F.array_position(ordered, F.get(found, F.lit(i))) for i in range(few)]
    first = F.get(F.array_intersect(ordered, found), F.lit(0))
    return (
        F.when(F.size(found) == 0, None)
        .when(F.size(found) <= few, F.least(*places))
        .otherwise(F.array_position(ordered, first))
    )


def _keyword_pattern(longest_first: list[str]) -> str:
    """Looks ahead from every space for the longest keyword that starts there, and captures it.

    Nothing is consumed, so overlapping keywords are all found. Keywords are grouped by their first
    character: a position where no keyword can start fails at once.
    """
    by_first: dict[str, list[str]] = {}
    for keyword in longest_first:
        by_first.setdefault(keyword[0], []).append(keyword[1:])
    options = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    return f"(?= ({options}) )"


def anchors(texts: DataFrame, rules: DataFrame, power: int) -> DataFrame:
    """Every keyword that can match, under the one of its words that the fewest texts hold.

    ``texts(_words)``. Counted are only words that keywords have, once a text; a keyword with a word
    that no text holds is left out.
    """
    parts = rules.select("*", F.posexplode(F.split("keyword", " ")).alias("_at", "word"))
    asked = texts.withColumn("_bits", member_bits(parts, "word", power))
    words = F.filter(F.array_distinct("_words"), lambda w: may_hold(F.col("_bits"), w, power))
    held = asked.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    known = parts.join(held, "word", "left")
    place = F.struct("held", "_at", "word")
    chosen = known.groupBy("keyword", "pos", "category").agg(
        F.min(place).alias("_anchor"), F.bool_and(F.col("held").isNotNull()).alias("possible"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    return chosen.filter("possible").select("keyword", "pos", "category", "n", "_anchor._at", "_anchor.word")


def anchored_places(texts: DataFrame, indexed: DataFrame, longest: int, power: int) -> DataFrame:
    """Only places of a text whose word may be an anchor: the word, its neighbours, and its place among them."""
    marked = texts.withColumn("_bits", member_bits(indexed, "word", power))
    words = F.col("_words")
    every = F.sequence(F.lit(0), F.size(words) - 1)
    hits = F.filter(every, lambda i: may_hold(F.col("_bits"), F.get(words, i), power))
    around = F.transform(hits, lambda i: F.struct(
        F.get(words, i).alias("word"),
        F.least(i, F.lit(longest - 1)).alias("_lead"),
        F.slice(words, F.greatest(i - (longest - 1), F.lit(0)) + 1, 2 * longest - 1).alias("_near"),
    ))
    return marked.select("_text_key", F.inline(around))


# Bits for the keywords of a large taxonomy: 8 MB at most, enough for four million of them.
MOST_KEYWORD_BITS = 26


def keyword_hits(texts: DataFrame, rules: DataFrame, sizes: list[int], power: int) -> DataFrame:
    """Runs of words that may be a keyword, by bits of a bounded size asked for every run: (``_text_key``, ``keyword``).

    A row a word with those behind it, and of these the runs as long as some keyword: plain columns, which
    stay in generated code where a lambda over every run would not.
    """
    bits, names = member_bits(rules, "keyword", power), [f"_w{i}" for i in range(max(sizes))]
    behind = F.arrays_zip(*[F.slice("_words", i + 1, F.size("_words")).alias(name) for i, name in enumerate(names)])
    placed = texts.select("_text_key", F.inline(behind).alias(*names))

    def run(n: int) -> Column:
        held = F.concat(*[x for name in names[:n] for x in (F.lit(" "), F.col(name))][1:])  # null at the text's end
        return F.when(may_hold(bits, held, power), held)

    every = placed.select("_text_key", F.explode(F.array(*[run(n) for n in sizes])).alias("keyword"))
    return every.filter("keyword IS NOT NULL")


def _categorize_by_runs(df: DataFrame, text: Column, rules: DataFrame, default: str) -> DataFrame:
    """A large taxonomy, by equality of whole keywords.

    Distinct texts are stored once. A run of as many words as some keyword has goes on only if it may be
    a keyword, and meets that one keyword in an equi-join: no run meets more than one, however many
    keywords share a word, so the rows grow with the texts alone.
    """
    rules = materialise(rules, "taxonomy-rules")
    counted = rules.groupBy(F.size(F.split("keyword", " ")).alias("words")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted(r.words for r in counted)  # as many rows as keywords have lengths
    power = power_for(sum(r.n for r in counted), MOST_KEYWORD_BITS)
    keyed = df.withColumn("_text", text)
    # by the whole text, which a hash aggregate takes as its key; one that keeps it beside a key would sort all rows
    distinct = keyed.select("_text").distinct().select(F.sha1(F.col("_text")).alias("_text_key"), F.split("_text", " ").alias("_words"))
    texts = materialise(distinct, "taxonomy-texts")
    found = keyword_hits(texts, rules, sizes, power).join(rules, "keyword").groupBy("_text_key").agg(
        F.min_by("category", F.struct(-F.length("keyword"), F.col("pos"))).alias("_found")
    )
    out = keyed.withColumn("_text_key", F.sha1(F.col("_text"))).join(found, "_text_key", "left")
    return out.select(*df.columns, F.coalesce("_found", F.lit(default)).alias("bug_category"))


def with_severity(
    df: DataFrame, severity: DataFrame, default: tuple[str, int] = V.DEFAULT_SEVERITY
) -> DataFrame:
    """Add ``syslog_level`` and ``severity_code`` of ``bug_category``."""
    known = unique(severity, "category", "severity_code", "syslog_level").withColumnRenamed("category", "bug_category")
    joined = df.join(known, "bug_category", "left")
    return joined.select(
        *[c for c in df.columns],
        F.coalesce("syslog_level", F.lit(default[0])).alias("syslog_level"),
        F.coalesce("severity_code", F.lit(default[1])).alias("severity_code"),
    )


def split_other(df: DataFrame, default: str = V.DEFAULT_CATEGORY) -> tuple[DataFrame, DataFrame]:
    """Rows with a keyword category (or none at all), and rows of the default one."""
    is_other = F.coalesce(F.lower("bug_category") == default.lower(), F.lit(False))
    return df.filter(~is_other), df.filter(is_other)
