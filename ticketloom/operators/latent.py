"""Dense text vectors without a supplied model: the leading singular vectors of the TF-IDF matrix.

A randomised factorisation in two passes over the distinct texts. The first multiplies the matrix by
itself and a few random columns, which span nearly what its leading singular vectors span; the second
measures the matrix on an orthonormal basis of these columns. What tasks send, and what the driver
factors, is as large as terms times columns, whatever the corpus. A text's vector is its TF-IDF row on
the leading directions; texts that share no word but words that occur together come near each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.phrases import text_weigher, tfidf_rows

RANK, MORE, TERMS = 32, 8, 4096


@dataclass
class LatentModel:
    """Terms, their idf, the directions (terms x rank) and the singular values that belong to them."""

    terms: list[str]
    idf: list[float]
    directions: np.ndarray
    strengths: np.ndarray

    def embedder(self) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
        """For the slot of ``text_features``; a text without a known word has the zero vector."""
        terms, idf, directions = self.terms, self.idf, self.directions

        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weigh = text_weigher(terms, idf)
            for batch in batches:
                yield pd.Series([weight @ directions[at] for at, weight in map(weigh, batch)], dtype=object)

        return embed


def _summed(rows: DataFrame, height: int, width: int, add: Callable[[np.ndarray, np.ndarray, int, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of a matrix to which ``add`` adds a row's (places, weights, times)."""
    columns = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((height, width))
        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            places, weights = batch.column(0).values.to_numpy(), batch.column(1).values.to_numpy()
            for a, b, n in zip(ends[:-1], ends[1:], batch.column(2).to_numpy()):
                add(places[a:b], weights[a:b], n, sums)
        kept = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept), *(pa.array(sums[kept, i]) for i in range(width))], names=["row", *columns])

    schema = "row long, " + ", ".join(f"{c} double" for c in columns)
    totals = rows.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns])
    out = np.zeros((height, width))
    for found in totals.collect():  # at most ``height`` rows
        out[found.row] = found[1:]
    return out


def fit_latent(df: DataFrame, col: str, rank: int = RANK, more: int = MORE, vocab: int = TERMS, seed: int = 42) -> LatentModel:
    """The ``rank`` leading directions of the TF-IDF rows of ``col``, over the ``vocab`` most frequent words.

    Fewer if there are fewer words. Equal texts count as often as they occur.
    """
    rows, terms, idf = tfidf_rows(df, col, vocab)
    width = min(rank + more, len(terms))
    if not width:
        return LatentModel([], [], np.zeros((0, 0)), np.zeros(0))
    drawn = np.random.RandomState(seed).standard_normal((len(terms), width))

    def product(at: np.ndarray, weight: np.ndarray, n: int, sums: np.ndarray) -> None:
        sums[at] += n * np.outer(weight, weight @ drawn[at])

    basis, _ = np.linalg.qr(_summed(rows, len(terms), width, product))

    def gram(at: np.ndarray, weight: np.ndarray, n: int, sums: np.ndarray) -> None:
        own = weight @ basis[at]
        sums += n * np.outer(own, own)

    values, vectors = np.linalg.eigh(_summed(rows, width, width, gram))
    first = np.argsort(-values)[:min(rank, width)]
    directions = basis @ vectors[:, first]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(first))])
    return LatentModel(terms, idf, directions * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[first], 0.0)))
