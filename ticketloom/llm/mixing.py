"""Mixing sources to target weights: iterative proportional fitting, then sampling by its result.

Token weights are summed over cells, one for each combination of the margins (source, language,
topic): the tokens that a tokenizer file gives for the whole text, or words where none is named.
Raking scales the cells to each margin's target shares in turn until all of them hold; a
cell's calibrated weight over its tokens says how much of it is wanted. A document is kept with its
cell's probability, by a hash of its key and text, so that the same document is always drawn alike.

With a ``share`` the sample holds that share of all tokens. A value whose target is more than it has
is taken whole and the others of its margin share the rest by their targets; a cell that would be
wanted more than once is taken whole and the rest is raked again. A rare source or a cell of one
document so moves nothing but itself. Without a ``share`` the scarcest cell sets the scale: it is
taken whole, all others in proportion, and the targets hold exactly.

The fit works on the table of cells alone. Up to ``LOCAL_CELLS`` of them are fetched, after a check of
their number, and raked as arrays; more are raked by joins with the sums of a margin, stored after every
round, to the same result. Margins that cannot hold together, or a fit that has not ended after
``ROUNDS``, show in ``_margin_error``: the largest difference of a margin's value from its amount, as a
share of all tokens. With a tokenizer the texts are read once: rows are stored with their tokens, margins
and draw, and only with the columns asked for. By words the corpus is read for the cells and for the draw. Null margins are a
value of their own; null and empty texts weigh nothing and are drawn with their cell. Rows equal in
key and text are drawn alike. An empty table gives an empty result. Working columns begin with an
underscore; columns of the input with any other names are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.fingerprints import words_of
from ticketloom.llm.tokenize import with_tokens
from ticketloom.session import materialise

TOLERANCE, ROUNDS = 1e-6, 200
# Target shares: a margin's own shares to this power, so that large sources shrink and small ones grow.
TEMPER = 0.9
# The share of all tokens that the registered query and the pipeline keep.
SHARE = 0.75
# No cell is wanted more often than this, where margins cannot hold together.
MOST_WANTED = 1e12
# Cells that are raked as arrays in the driver: a row of some margin values and a number each.
LOCAL_CELLS = 100_000


def token_weight(text: Column) -> Column:
    """Words, as the weight of a document."""
    return F.size(words_of(text)).cast("double")


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the text, read whole: licence, table, or prose by its number of words."""
    n = F.size(words_of(text))
    return (
        F.when(F.contains(text, F.lit(" License")), "licence")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(n < 150, "note")
        .when(n < 600, "article")
        .otherwise("long form")
    )


def tempered_targets(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """A margin's values with target shares proportional to a power of their own shares."""
    sums = cells.groupBy(margin).agg(F.sum("_tokens").alias("_sum")).filter("_sum > 0")
    raised = sums.select(margin, F.pow("_sum", F.lit(power)).alias("_raised"))
    whole = raised.agg(F.sum("_raised")).scalar()
    return raised.select(margin, (F.col("_raised") / whole).alias("_target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``_weight`` raked to the target shares of every margin.

    A value without a target gets weight 0; a target without tokens is left out of its margin. Stops
    when a whole round moves no more than ``tolerance`` of the weight.
    """
    fitted = cells.withColumn("_weight", F.col("_tokens"))
    for _ in range(rounds):
        step = fitted.withColumn("_before", F.col("_weight"))
        for margin, target in targets.items():
            sums = step.groupBy(margin).agg(F.sum("_weight").alias("_sum"))
            share = F.when(F.col("_sum") > 0, F.coalesce("_target", F.lit(0.0)) / F.col("_sum")).otherwise(0.0)
            factors = sums.join(target, sums[margin].eqNullSafe(target[margin]), "left").select(
                sums[margin].alias("_value"), share.alias("_factor")
            )
            step = step.join(factors, step[margin].eqNullSafe(F.col("_value"))).select(
                *cells.columns, "_before", (F.col("_weight") * F.col("_factor")).alias("_weight")
            )
        step = materialise(step, "raked")
        change = step.agg(F.sum(F.abs(F.col("_weight") - F.col("_before")))).first()[0] or 0.0
        fitted = step.drop("_before")
        if change <= tolerance:
            break
    return fitted


def calibrated(cells: DataFrame) -> DataFrame:
    """Cells with ``_probability``: the calibrated weight per token, 1 for the scarcest cell."""
    ratio = F.when(F.col("_tokens") > 0, F.col("_weight") / F.col("_tokens"))
    rated = cells.withColumn("_ratio", ratio)
    most = rated.agg(F.max("_ratio")).scalar()
    # a cell without tokens cannot upset the shares and is kept
    return rated.withColumn("_probability", F.coalesce(F.least(F.col("_ratio") / most, F.lit(1.0)), F.lit(1.0)))


def amounts(cells: DataFrame, targets: dict[str, DataFrame], share: float) -> dict[str, DataFrame]:
    """For every margin its values with ``_amount``, the tokens wanted of each, in all ``share`` of the tokens.

    By the targets, but no more of a value than it has: what it lacks goes to the others by their targets.
    """
    supplies = {}
    for margin, target in targets.items():
        sums = cells.groupBy(margin).agg(F.sum("_tokens").alias("_supply"))
        known = sums.join(target, sums[margin].eqNullSafe(target[margin])).filter("_supply > 0 AND _target > 0")
        supplies[margin] = materialise(known.select(sums[margin].alias("_value"), "_supply", "_target"), "supplies")
    offered = [s.agg(F.sum("_supply")).first()[0] or 0.0 for s in supplies.values()]
    budget = min([share * (cells.agg(F.sum("_tokens")).first()[0] or 0.0), *offered])
    made = {}
    for margin, supply in supplies.items():
        level, risen = 0.0, True
        while risen:
            whole = F.col("_supply") <= level * F.col("_target")
            held, rest = supply.agg(
                F.sum(F.when(whole, F.col("_supply")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(F.col("_target")))
            ).first()
            risen = bool(rest) and (budget - held) / rest > level * (1 + 1e-12)
            level = (budget - held) / rest if risen else level
        made[margin] = supply.select("_value", F.least("_supply", level * F.col("_target")).alias("_amount"))
    return made


def filled(
    cells: DataFrame, targets: dict[str, DataFrame], share: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> DataFrame:
    """Cells with ``_probability``: raked to the amounts of every margin, no cell beyond the tokens it has.

    A full cell stays full while its weight is at least its tokens; the factor of a value is the one
    that gives its amount if the same cells stay full (Newton's step, which ends there from any side).
    """
    wanted = {m: materialise(a, "amounts") for m, a in amounts(cells, targets, share).items()}
    taken, full = F.least("_weight", "_tokens"), F.col("_weight") >= F.col("_tokens")
    fitted = cells.withColumn("_weight", share * F.col("_tokens"))
    for _ in range(rounds):
        step = fitted.withColumn("_before", taken)
        for margin, amount in wanted.items():
            sums = step.groupBy(F.col(margin).alias("_key")).agg(
                F.sum("_tokens").alias("_supply"),
                F.sum(F.when(full, F.col("_tokens")).otherwise(0.0)).alias("_full"),
                F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("_free"),
                F.max(F.when(F.col("_weight") > 0, F.col("_tokens") / F.col("_weight"))).alias("_rise"),
            )
            asked = F.coalesce("_amount", F.lit(0.0))
            factor = (
                F.when(asked >= F.col("_supply") * (1 - 1e-12), F.coalesce("_rise", F.lit(1.0)))
                .when((asked > F.col("_full")) & (F.col("_free") > 0), (asked - F.col("_full")) / F.col("_free"))
                .when(F.col("_full") + F.col("_free") > 0, asked / (F.col("_full") + F.col("_free")))
                .otherwise(0.0)
            )
            factors = sums.join(amount, F.col("_key").eqNullSafe(F.col("_value")), "left").select("_key", factor.alias("_factor"))
            raised = F.least(F.col("_weight") * F.col("_factor"), F.col("_tokens") * MOST_WANTED)
            step = step.join(factors, F.col(margin).eqNullSafe(F.col("_key"))).select(
                *cells.columns, "_before", raised.alias("_weight")
            )
        step = materialise(step, "raked")
        change, whole = step.agg(F.sum(F.abs(taken - F.col("_before"))), F.sum("_tokens")).first()
        fitted = step.drop("_before")
        if (change or 0.0) <= tolerance * (whole or 0.0):
            break
    # a cell without tokens cannot upset the shares and is kept
    return fitted.withColumn("_probability", F.when(F.col("_tokens") > 0, taken / F.col("_tokens")).otherwise(1.0))


def amounts_of(supply: np.ndarray, target: np.ndarray, budget: float) -> np.ndarray:
    """``amounts`` of one margin as arrays: its values' supplies and target shares, none below zero."""
    level = 0.0
    while True:
        whole = supply <= level * target
        rest = target[~whole].sum()
        risen = (budget - supply[whole].sum()) / rest if rest else level
        if not risen > level * (1 + 1e-12):
            return np.minimum(supply, level * target)
        level = risen


def filled_arrays(
    codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], share: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> tuple[np.ndarray, float]:
    """``filled`` on arrays: every cell's probability, and the largest difference of a margin as a share of the tokens.

    ``codes`` number a margin's value in every cell, ``targets`` gives the value's share, 0 without one.
    """
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens)), 0.0
    supplies = [np.bincount(c, tokens, len(t)) for c, t in zip(codes, targets)]
    budget = min([share * total, *(s[t > 0].sum() for s, t in zip(supplies, targets))])
    wanted = [amounts_of(np.where(t > 0, s, 0.0), t, budget) for s, t in zip(supplies, targets)]
    weight = share * tokens
    for _ in range(rounds):
        before = np.minimum(weight, tokens)
        for code, supply, asked in zip(codes, supplies, wanted):
            full = weight >= tokens
            held = np.bincount(code, np.where(full, tokens, 0.0), len(asked))
            free = np.bincount(code, np.where(full, 0.0, weight), len(asked))
            rise = np.zeros(len(asked))
            np.maximum.at(rise, code[weight > 0], tokens[weight > 0] / weight[weight > 0])
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(held + free > 0, asked / (held + free), 0.0)
                factor = np.where((asked > held) & (free > 0), (asked - held) / free, factor)
            factor = np.where(asked >= supply * (1 - 1e-12), np.where(rise > 0, rise, 1.0), factor)
            weight = np.minimum(weight * factor[code], tokens * MOST_WANTED)
        if np.abs(np.minimum(weight, tokens) - before).sum() <= tolerance * total:
            break
    taken = np.minimum(weight, tokens)
    error = max(np.abs(np.bincount(c, taken, len(a)) - a).max() for c, a in zip(codes, wanted)) / total
    return np.where(tokens > 0, taken / np.where(tokens > 0, tokens, 1.0), 1.0), float(error)


def _margin_error(fitted: DataFrame, wanted: dict[str, DataFrame]) -> float:
    """The largest difference of a margin's value from its amount, as a share of all tokens."""
    total, worst = fitted.agg(F.sum("_tokens")).first()[0] or 0.0, 0.0
    for margin, amount in wanted.items():
        sums = fitted.groupBy(F.col(margin).alias("_key")).agg(F.sum(F.col("_probability") * F.col("_tokens")).alias("_taken"))
        both = sums.join(amount, F.col("_key").eqNullSafe(F.col("_value")), "left")
        worst = max(worst, both.agg(F.max(F.abs(F.col("_taken") - F.coalesce("_amount", F.lit(0.0))))).first()[0] or 0.0)
    return worst / total if total else 0.0


def probabilities(cells: DataFrame, aims: dict[str, DataFrame], share: float, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The cells with ``_probability`` and ``_margin_error``, raked as arrays or, beyond ``local_cells``, as tables."""
    rows = cells.limit(local_cells + 1).collect()
    if len(rows) > local_cells:
        fitted = filled(cells, aims, share)
        return fitted.withColumn("_margin_error", F.lit(_margin_error(fitted, amounts(cells, aims, share))))
    codes, targets = [], []
    for margin, aim in aims.items():
        place = {v: i for i, v in enumerate(dict.fromkeys(r[margin] for r in rows))}
        target = np.zeros(len(place))
        for value, wanted in aim.select(margin, "_target").collect():  # no more than cells
            if value in place:
                target[place[value]] = wanted or 0.0
        codes.append(np.array([place[r[margin]] for r in rows], np.int64))
        targets.append(target)
    found, error = filled_arrays(codes, np.array([r["_tokens"] or 0.0 for r in rows], np.float64), targets, share)
    schema = T.StructType([*cells.schema, T.StructField("_probability", T.DoubleType()), T.StructField("_margin_error", T.DoubleType())])
    return cells.sparkSession.createDataFrame([(*r, float(p), error) for r, p in zip(rows, found)], schema)


def draw(key: str, text: str, seed: int) -> Column:
    """A number in [0, 1) from a row's key and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), 11)
    return bits / F.lit(float(1 << 53))


def mix(
    df: DataFrame, margins: dict[str, Column], key: str = "doc_id", text: str = "text",
    targets: Callable[[DataFrame, str], DataFrame] = tempered_targets, seed: int = 97, share: float | None = None,
    tokenizer: str | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` (or those of ``keep``) with ``_tokens``, ``_probability``, ``_sampled`` and ``_margin_error``.

    ``margins`` names the margins and gives the expression of each; ``targets`` gives a margin's
    values with their shares from the cells; ``share`` is the share of all tokens to keep, None to let
    the scarcest cell decide. ``tokenizer`` is the file whose tokens weigh, None to weigh by words.
    """
    names, keep = {m: f"_{m}" for m in margins}, df.columns if keep is None else keep
    shown = df.withColumns({names[m]: c for m, c in margins.items()} | {"_draw": draw(key, text, seed)})
    carried = [*keep, *names.values(), "_draw"]
    if tokenizer:
        counted = with_tokens(shown, text, tokenizer, carried, "_own")
        shown = materialise(counted.withColumn("_own", F.col("_own").cast("double")), "weighed")
    else:
        shown = shown.select(*carried, token_weight(F.col(text)).alias("_own"))
    cells = materialise(shown.groupBy(*names.values()).agg(F.sum("_own").alias("_tokens")), "cells")
    aims = {c: materialise(targets(cells, c), "targets") for c in names.values()}
    if share is None:
        fitted = calibrated(rake(cells, aims)).withColumn("_margin_error", F.lit(None).cast("double"))
    else:
        fitted = probabilities(cells, aims, share)
    rated = materialise(
        fitted.select(*[F.col(c).alias(f"{c}_cell") for c in names.values()], "_probability", "_margin_error"), "probabilities"
    )
    same = F.lit(True)
    for c in names.values():
        same = same & shown[c].eqNullSafe(rated[f"{c}_cell"])
    return (
        shown.join(rated, same)
        .withColumn("_sampled", F.col("_draw") < F.col("_probability"))
        .drop(*[f"{c}_cell" for c in names.values()], "_draw")
        .withColumnRenamed("_own", "_tokens")
    )


def default_margins(text: str = "text") -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text))}
