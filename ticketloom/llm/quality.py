"""Document quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one measure of a text and votes good, bad or abstains. How often a rule is right
on good and on bad documents is not known; expectation-maximisation estimates it, and the share of
good documents, from how the rules agree. A document's verdict is the posterior probability that it
is good. Texts count by their pattern of votes, of which there are at most 3 ** rules, so the fit
needs one small aggregate of the corpus, whatever its size.

Words are runs of anything but the six ASCII white-space characters. Null and empty texts have no
words; all their rules but the length abstain. Long texts are read whole. Rows that repeat are judged
alike. An empty table gives an empty result. Only the columns asked for are kept, so extra columns
never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SENTENCE_END = (".", "!", "?", "…", "。", ":", ";", '"', "”", "»", ")")
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines",
    "n_marks", "n_distinct_words",
]
GOOD, BAD, ABSTAIN = 1, 0, 2


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures; votes bad and good outside and inside given bounds, else abstains."""

    name: str
    top: str
    bottom: str | None
    good: tuple[float, float]
    fair: tuple[float, float]

    def votes(self, m: dict[str, np.ndarray]) -> np.ndarray:
        top = m[self.top].astype(float)
        base = m[self.bottom].astype(float) if self.bottom else np.ones_like(top)
        x = np.divide(top, base, out=np.full_like(top, np.nan), where=base > 0)
        good = (x >= self.good[0]) & (x <= self.good[1])
        fair = (x >= self.fair[0]) & (x <= self.fair[1])
        return np.where(np.isnan(x), ABSTAIN, np.where(good, GOOD, np.where(fair, ABSTAIN, BAD)))


INF = float("inf")
RULES = [
    Rule("length", "n_words", None, (100, INF), (50, INF)),
    Rule("symbols", "n_symbols", "word_chars", (0, 0.01), (0, 0.05)),
    Rule("marks", "n_marks", "word_chars", (0, 0.08), (0, 0.16)),
    Rule("line copies", "n_dup_lines", "n_lines", (0, 0.1), (0, 0.4)),
    Rule("repeated words", "n_repeat_words", "n_words", (0, 0.15), (0, 0.4)),
    Rule("distinct words", "n_distinct_words", "n_words", (0.3, 1), (0.1, 1)),
    Rule("word length", "word_chars", "n_words", (3.5, 8), (2.5, 12)),
    Rule("ended lines", "n_ended_lines", "n_lines", (0.7, 1), (0.2, 1)),
]


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    ended = sum(line.rstrip(SPACE).endswith(SENTENCE_END) for line in lines)
    return (
        n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(seen)),
        len(lines), ended, len(raw) - len(raw.translate(None, MARKS)), len(seen),
    )


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words within a window of three words that is found twice or more, the first time included."""
    if len(ids) < 4:
        return 0
    if kinds < 2_000_000:  # three numbers fit into 63 bits
        keys = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
        _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        windows = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1)
        _, at, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    hit = counts[at.ravel()] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(ids) - 2 + shift] |= hit
    return int(covered.sum())


def pattern_of(m: dict[str, np.ndarray], rules: list[Rule]) -> np.ndarray:
    """All votes of a document as one number to base 3."""
    made = np.zeros(len(m["n_words"]), np.int64)
    for rule in rules:
        made = made * 3 + rule.votes(m)
    return made


def _measured(batches: Iterator[pa.RecordBatch], at: int, rules: list[Rule]) -> Iterator[tuple[pa.RecordBatch, dict, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            rows = [measure(t) for t in part.column(at).to_pylist()]
            m = dict(zip(MEASURES, np.array(rows, np.int64).reshape(-1, len(MEASURES)).T))
            yield part, m, pattern_of(m, rules)


def measures(df: DataFrame, text: str, keep: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """``keep`` with the measures of every text and its pattern of votes."""
    longs = [T.StructField(c, T.LongType()) for c in [*MEASURES, "pattern"]]
    schema = T.StructType([*[df.schema[c] for c in keep], *longs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m, pattern in _measured(batches, len(keep), rules):
            made = [pa.array(x) for x in [*m.values(), pattern]]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def posteriors(counts: dict[int, int], rules: int, steps: int = 500) -> dict[int, float]:
    """Expectation-maximisation over the patterns: the probability of good for each.

    The start takes every rule for right in eight cases of ten and eight documents of ten for good,
    which also settles which class is which. One document of each kind of vote is added to the
    counts, so that no probability becomes 0 or 1.
    """
    patterns = np.array(sorted(counts), np.int64)
    if not len(patterns):
        return {}
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    votes = np.stack([patterns // 3 ** (rules - 1 - j) % 3 for j in range(rules)], axis=1)
    said = np.stack([votes == BAD, votes == GOOD], axis=2).astype(float)  # pattern, rule, vote
    good_rate = np.tile([0.2, 0.8], (rules, 1))  # how a good document's rules vote: bad, good
    bad_rate = good_rate[:, ::-1].copy()
    prior, before = 0.8, None
    for _ in range(steps):
        on_good = np.log(prior) + np.einsum("pjv,jv->p", said, np.log(good_rate))
        on_bad = np.log1p(-prior) + np.einsum("pjv,jv->p", said, np.log(bad_rate))
        good = 1 / (1 + np.exp(np.clip(on_bad - on_good, -700, 700)))
        if before is not None and np.abs(good - before).max() < 1e-9:
            break
        before = good
        prior = (np.sum(weight * good) + 1) / (weight.sum() + 2)
        for rate, share in ((good_rate, good), (bad_rate, 1 - good)):
            total = np.einsum("p,pjv->jv", weight * share, said) + 1
            rate[:] = total / total.sum(axis=1, keepdims=True)
    return dict(zip(patterns.tolist(), good.tolist()))


def fit(measured: DataFrame, rules: list[Rule] = RULES) -> dict[int, float]:
    """The posterior of every pattern met among the documents that are still open to a verdict.

    At most 3 ** rules rows reach the driver.
    """
    open_ones = measured.filter(~base_failed())
    return posteriors(dict(open_ones.groupBy("pattern").count().collect()), len(rules))


def base_failed() -> F.Column:
    """Too short, or more than half of the words repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, known: dict[int, float], threshold: float = 0.5) -> DataFrame:
    """Add ``posterior`` (null where the base failed), ``base_failed`` and ``kept``."""
    spark = measured.sparkSession
    table = spark.createDataFrame(sorted(known.items()), "pattern long, posterior double")  # at most 3 ** rules rows
    joined = measured.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", base_failed())
    posterior = F.when(~F.col("base_failed"), F.col("posterior"))
    verdict = F.coalesce(posterior >= threshold, F.lit(False))
    return joined.withColumns({"posterior": posterior, "kept": verdict})


def keep_good(df: DataFrame, text: str, known: dict[int, float], threshold: float = 0.5, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns as they are; no shuffle."""
    columns, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m, pattern in _measured(batches, at, rules):
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            good = np.array([known.get(p, 0.0) >= threshold for p in pattern.tolist()], bool)
            yield part.filter(pa.array(good & ~failed))

    return df.select(*columns).mapInArrow(run, df.schema)
