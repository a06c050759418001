"""Hard negatives: rows of another label that score nearly as high as an anchor's positives, by cover trees.

Scores are inner products of integer vectors. A coordinate is added to every candidate that gives all
of a block the same norm, so they lie on a sphere and a score falls with the angle to the anchor (whose
own added coordinate is 0). A block of candidates is a cover tree: at each level the allowed radius
shrinks by a constant, a node's children are points farther apart than that radius, and every point goes
to the nearest. A node keeps the largest distance to what it covers; as an angle, that bounds from above
and below what any point below the node can score. A search goes to the node of the highest bound first,
passes over nodes that lie outside its window of scores or below the worst result it would replace, and
computes the scores in leaves exactly.

Rows of equal vector and label are one point of the tree with its least keys, as many as one result can
name; no result can name more of them, so nothing is lost, and a vector that a third of all rows share is
one point. Anchors of equal vector and label ask once. Points are dealt to blocks of bounded size by a
hash, questions go to all blocks, and every block answers with its best few; the best of all blocks are a
ranking that Spark limits before its shuffle. A first search finds the positives, a second one the
negatives of all their windows.

Rows with a null key, label or vector or a null component take no part; rows that repeat in key, vector
and label count once; ties go to the smaller key. Vectors of different lengths never meet. Squared norms
must stay below 2 ** 52, where sums are exact; a larger one is an error. An empty table, or one without
anchors, gives an empty result. Only named columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.session import materialise

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
# Points of a block, and questions that one copy of a block answers.
BLOCK_POINTS, BLOCK_QUESTIONS = 8192, 50_000
# Points of a leaf, and how much the radius shrinks from level to level.
LEAF, SHRINK = 8, 1.3
MOST_NORM = 1 << 52
NO_LIMIT = 1 << 62


class CoverTree:
    """Points of equal dimension, each with a label and its ascending keys."""

    def __init__(self, vectors: np.ndarray, labels: list, keys: list[list[int]]):
        self.vectors, self.labels, self.keys = vectors.astype(np.float64), labels, keys
        squares = (self.vectors**2).sum(axis=1)
        self.norm = float(np.sqrt(squares.max(initial=0.0)))
        self.lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(self.norm**2 - squares, 0.0))])
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.kids: list[tuple[int, int] | None] = []
        self.points: list[np.ndarray | None] = []
        self._build()
        self.centres = self.vectors[self.centre]
        if self.norm:
            self.angle = 2 * np.arcsin(np.minimum(1.0, np.array(self.radius) / (2 * self.norm)))
        else:
            self.angle = np.zeros(len(self.radius))

    def _add(self, centre: int, members: np.ndarray, distances: np.ndarray) -> tuple:
        self.centre.append(centre)
        self.radius.append(float(distances.max(initial=0.0)))
        self.kids.append(None)
        self.points.append(members)
        return len(self.centre) - 1, members, distances

    def _distances(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.lifted[members] - self.lifted[centre]) ** 2).sum(axis=1))

    def _build(self) -> None:
        every = np.arange(len(self.vectors))
        level = [self._add(0, every, self._distances(every, 0))] if len(every) else []
        allowed = self.radius[0] if self.radius else 0.0
        while level:
            allowed /= SHRINK
            below = []
            for node, members, distances in level:
                if len(members) <= LEAF or self.radius[node] == 0.0:
                    continue
                if self.radius[node] <= allowed:  # covered by this level as it is
                    below.append((node, members, distances))
                    continue
                centres, nearest, owner = [self.centre[node]], distances.copy(), np.zeros(len(members), np.int64)
                while nearest.max() > allowed:
                    far = int(nearest.argmax())
                    away = self._distances(members, int(members[far]))
                    closer = away < nearest
                    nearest[closer], owner[closer] = away[closer], len(centres)
                    centres.append(int(members[far]))
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
                first = len(self.centre)
                for i, centre in enumerate(centres):
                    own = order[cuts[i]:cuts[i + 1]]
                    below.append(self._add(centre, members[own], nearest[own]))
                self.kids[node], self.points[node] = (first, len(self.centre)), None
            level = below

    def search(self, question: np.ndarray) -> Search:
        return Search(self, question)


class Search:
    """The searches of one question in one tree; bounds of a node's children are computed once."""

    def __init__(self, tree: CoverTree, question: np.ndarray):
        self.tree, self.question = tree, question.astype(np.float64)
        self.length = float(np.sqrt(self.question @ self.question)) * tree.norm
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _bounds(self, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that points below the nodes can score."""
        tree = self.tree
        scores = tree.centres[nodes] @ self.question
        if not self.length:
            return np.zeros_like(scores), np.zeros_like(scores)
        angle, reach = np.arccos(np.clip(scores / self.length, -1.0, 1.0)), tree.angle[nodes]
        slack = 1e-7 * self.length + 1e-3  # for rounding
        most = self.length * np.cos(np.maximum(angle - reach, 0.0)) + slack
        least = self.length * np.cos(np.minimum(angle + reach, np.pi)) - slack
        return least, most

    def _children(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.known.get(node)
        if found is None:
            a, b = self.tree.kids[node]
            least, most = self._bounds(slice(a, b))
            order = np.argsort(-most, kind="stable")
            found = self.known[node] = order + a, least[order], most[order]
        return found

    def best(self, count: int, same: bool, label, low: int = -NO_LIMIT, high: int = NO_LIMIT) -> list[tuple[int, int, int]]:
        """The first ``count`` (score, key, point) by score, then key, with ``low <= score <= high``.

        ``same``: of the question's label; otherwise of any other.
        """
        tree, found = self.tree, []
        if not tree.centre or low > high:
            return found
        heap: list[tuple[float, int, np.ndarray, np.ndarray, int]] = []

        def worst() -> float:
            return found[-1][0] if len(found) >= count else low

        def queue(nodes: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
            open_ = (least <= high) & (most >= worst())
            if open_.any():
                nodes, most = nodes[open_], np.minimum(most[open_], float(high))
                heappush(heap, (-float(most[0]), int(nodes[0]), nodes, most, 0))

        least, most = self._bounds(slice(0, 1))
        queue(np.zeros(1, np.int64), least, most)
        while heap:
            bound, node, nodes, bounds, at = heappop(heap)
            if -bound < worst():
                break
            if at + 1 < len(nodes):
                heappush(heap, (-float(bounds[at + 1]), int(nodes[at + 1]), nodes, bounds, at + 1))
            if tree.kids[node] is not None:
                queue(*self._children(node))
                continue
            members = tree.points[node]
            scores = (tree.vectors[members] @ self.question).astype(np.int64)
            for point, score in zip(members.tolist(), scores.tolist()):
                if low <= score <= high and score >= worst() and (tree.labels[point] == label) == same:
                    found += [(score, key, point) for key in tree.keys[point]]
                    found.sort(key=lambda x: (-x[0], x[1]))
                    del found[count:]
        return found


def points_of(rows: DataFrame, most: int) -> DataFrame:
    """Distinct (vector, label) with ``keys``, the ``most`` least keys of its rows, ascending."""
    order = Window.partitionBy("vector", "label").orderBy("key")
    first = rows.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return first.groupBy("vector", "label").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def _answered(points: DataFrame, questions: DataFrame, blocks: int, parts: int, work, schema: str) -> DataFrame:
    """``work(tree, question row)`` for every question at every block of points."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("vector").alias("_size")
    own = F.pmod(F.xxhash64("vector", "label"), F.lit(blocks)).cast("int").alias("_block")
    part = F.pmod(F.xxhash64("question"), F.lit(parts)).cast("int").alias("_part")
    kinds = dict(questions.dtypes)
    held = points.select(
        size, own, every(parts).alias("_part"), F.lit(None).cast("binary").alias("question"), "vector", "label", "keys",
        F.lit(None).cast(kinds["windows"]).alias("windows"),
    )
    asked = questions.select(
        size, every(blocks).alias("_block"), part, "question", "vector", "label",
        F.lit(None).cast("array<bigint>").alias("keys"), "windows",
    )
    place = ["_size", "_block", "_part"]
    dealt = held.unionByName(asked).repartition(*place).sortWithinPartitions(*place, F.col("question").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        now, tree, vectors, labels, keys = None, None, [], [], []
        kind = None
        for batch in batches:
            kind = kind or pa.schema([(n, pa.binary() if n == "question" else pa.bool_() if n == "own" else pa.int64()) for n in names])
            out: list[tuple] = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7)))):
                *at, question, label, own_keys, windows = row
                vector = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                if at != now:
                    now, tree, vectors, labels, keys = at, None, [], [], []
                if question is None:
                    vectors.append(vector)
                    labels.append(label)
                    keys.append(own_keys)
                    continue
                if tree is None:
                    shape = (len(vectors), at[0])
                    tree = CoverTree(np.array(vectors, np.float64).reshape(shape), labels, keys)
                out += work(tree, question, vector, label, windows)
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], names=names)

    return dealt.mapInArrow(run, schema)


def _first(df: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "key")
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count)


def mine(
    df: DataFrame, key: str, vector: str, label: str, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, block_points: int = BLOCK_POINTS, block_questions: int = BLOCK_QUESTIONS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchor`` holds.

    A positive is one of the first ``positives`` other rows of the anchor's label; its negatives are the first
    ``negatives`` rows of another label whose score lies between ``low`` and ``high`` hundredths of its own.
    Key and label must be whole numbers, the vector an array of them.
    """
    asked = F.coalesce(anchor, F.lit(False)).alias("asks")
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(vector).cast("array<bigint>").alias("vector"), F.col(label).cast("long").alias("label"), asked,
    ).dropna(subset=["key", "vector", "label"]).filter(~F.exists("vector", lambda x: x.isNull()))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    large = F.raise_error(F.lit("a vector's squared norm is 2 ** 52 or more")).cast("array<bigint>")
    rows = rows.withColumn("vector", F.when(square < F.lit(float(MOST_NORM)), F.col("vector")).otherwise(large))
    # who asks together: anchors of one vector and label
    group = F.unhex(F.md5(F.concat_ws(",", F.col("vector").cast("array<string>"), F.concat(F.lit("label "), F.col("label").cast("string"))).cast("binary")))
    anchors = materialise(rows.filter("asks").select("key", "vector", "label", group.alias("question")).distinct(), "anchors")
    points = materialise(points_of(rows.drop("asks"), max(negatives, positives + 1)), "points")
    questions = anchors.groupBy("question").agg(F.first("vector").alias("vector"), F.first("label").alias("label"))
    questions = materialise(questions, "questions")

    n, cores = points.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, ceil(n / block_points), min(cores, ceil(n / 1024)))
    parts = max(1, ceil(questions.count() / block_questions))

    def liked(tree: CoverTree, question: bytes, vector: np.ndarray, label: int, _) -> list[tuple]:
        found = tree.search(vector).best(positives + 1, True, label)
        return [(question, key, score, bool((tree.vectors[point] == vector).all())) for score, key, point in found]

    unasked = questions.withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = _answered(points, unasked, blocks, parts, liked, "question binary, key long, score long, own boolean")
    near = materialise(_first(near, ["question"], positives + 1), "positives")
    ranked = near.groupBy("question").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "key", "own"))).alias("found")  # positives + 1 at most
    )

    def refused(tree: CoverTree, question: bytes, vector: np.ndarray, label: int, windows: list[int]) -> list[tuple]:
        search, out = tree.search(vector), []
        for score in windows:
            least, most = -(-low * score // 100), high * score // 100  # whole scores within the window
            for negative, key, _ in search.best(negatives, False, label, least, most):
                out.append((question, score, key, negative))
        return out

    windows = near.groupBy("question").agg(F.collect_set("score").alias("windows"))
    far = _answered(
        points, questions.join(windows, "question"), blocks, parts, refused, "question binary, window long, key long, score long"
    )
    far = materialise(_first(far, ["question", "window"], negatives), "negatives").select(
        "question", F.col("window").alias("positive_score"), F.col("_n").alias("rank"), F.col("key").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    others = F.slice(F.filter("found", lambda x: ~(x.own & (x.key == F.col("anchor_id")))), 1, positives)
    pairs = (
        anchors.select(F.col("key").alias("anchor_id"), "question").join(ranked, "question")
        .select("anchor_id", "question", F.explode(others).alias("positive"))
        .select("anchor_id", "question", F.col("positive.key").alias("positive_id"), (-F.col("positive.down")).alias("positive_score"))
    )
    return pairs.join(far, ["question", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
