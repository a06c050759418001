"""Text features, bug classifier with self-training, re-labelling and clustering of ``Other``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, ElementwiseProduct, HashingTF, IndexToString, Normalizer, RegexTokenizer, StringIndexerModel, VectorAssembler,
    VectorSlicer,
)
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketloom import fixed_values as V
from ticketloom.functions import text as X
from ticketloom.functions.counts import row_count
from ticketloom.operators.lookup import bounded_rows
from ticketloom.operators.aggregates import classification_report
from ticketloom.operators.taxonomy import split_other
from ticketloom.session import materialise


# Bounds of the solvers: as far as the described library would go, in the search and in the final fit.
MAX_ITERATIONS, TOLERANCE = 1000, 1e-5
CLUSTER_ITERATIONS = 300
# The solvers of the grid: whether the intercept is a feature like any other, and so penalised too.
SOLVERS = {"liblinear": True, "lbfgs": False}
WITH_ONE = "features_and_one"
WEIGHTS = ("unit", "balanced")


# --- splits ------------------------------------------------------------------------------------

def ranked_by_hash(df: DataFrame, group: str, key: str, seed: int = 42, hex_digits: int = 3) -> DataFrame:
    """Add ``_rank`` (from 1) and ``_size``: each row's place in its group by a seeded hash.

    One window per group would put a hot group into one task. The leading hex digits of the hash
    cut each group into even slices; rows rank within a slice, and the counts of the slices before
    it, a table of groups x slices, give the offset. More digits give smaller slices.
    """
    drawn = df.withColumn("_draw", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    drawn = drawn.withColumn("_slice", F.substring("_draw", 1, hex_digits))
    before = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = drawn.groupBy(group, "_slice").agg(row_count().alias("_n"))
    offsets = slices.select(
        group, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(group)).alias("_size"),
    )
    within = F.row_number().over(W.partitionBy(group, "_slice").orderBy("_draw", key))
    ranked = drawn.withColumn("_within", within).join(offsets, [group, "_slice"])
    return ranked.select(
        *df.columns, (F.col("_within") + F.col("_before")).alias("_rank"), "_size"
    )


def stratified_split(
    df: DataFrame, label: str, key: str, frac: float = 0.75, seed: int = 42
) -> DataFrame:
    """Add ``is_train``: exactly the rounded share of every class, drawn by hash."""
    ranked = ranked_by_hash(df, label, key, seed)
    take = F.floor(F.col("_size") * frac + 0.5)
    return ranked.select(*df.columns, (F.col("_rank") <= take).cast("int").alias("is_train"))


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: every class dealt out evenly, in hash order."""
    ranked = ranked_by_hash(df, label, key, seed)
    return ranked.select(*df.columns, ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


# --- features ----------------------------------------------------------------------------------

def fit_text_features(df: DataFrame, col: str, dimensions: int = 1 << 18) -> PipelineModel:
    """Hashed, idf-weighted, unit-length word vectors. One pass over the texts."""
    stages = [
        RegexTokenizer(inputCol=col, outputCol="_tokens", pattern=r"\s+", minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=1),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(col))


def text_features(
    df: DataFrame, col: str, embedder: Callable | None = None, model: PipelineModel | None = None,
    vectors: str | None = None,
) -> DataFrame:
    """Add ``features``; an empty text has the zero vector.

    ``vectors`` names a column of supplied embeddings, arrays of one length, which are then used.
    ``embedder`` maps an iterator of text Series to Series of float lists and runs in Arrow
    batches. Without one, ``model`` (or a model fitted on ``df``) makes hashed word vectors.
    """
    if vectors is not None:
        given = F.col(vectors).cast("array<double>")
        zeros = F.transform(given, lambda x: F.lit(0.0))
        return df.withColumn("features", array_to_vector(F.when(F.col(col) == "", zeros).otherwise(given)))
    if embedder is not None:
        udf = F.pandas_udf(embedder, "array<float>")
        made = df.withColumn("_raw", udf(F.col(col)))
        zeros = F.transform("_raw", lambda x: F.lit(0.0).cast("float"))
        raw = F.when(F.col(col) == "", zeros).otherwise(F.col("_raw"))
        return made.withColumn("features", array_to_vector(raw.cast("array<double>"))).drop("_raw")
    fitted = model or fit_text_features(df, col)
    return fitted.transform(df).drop("_tokens", "_tf", "_tfidf")


def content_of(vector: Column) -> Column:
    """What equal vectors share."""
    return F.md5(vector.cast("string").cast("binary"))


def shrunk(df: DataFrame, by: list[str], sums: list[str], features: str = "features") -> DataFrame:
    """Rows of equal ``features`` and ``by`` as one row with the sums of their weights.

    Fits that weigh their rows give the same on it. A vector that very many rows share is combined
    before the shuffle and is one row after it. The result is dealt and sorted by content, so it does
    not depend on how the input was cut; a small one comes in few partitions, as fits read it often.
    The vector is part of the key: kept beside it, it would have every task sort all its rows.
    """
    keyed = df.withColumn("_content", content_of(F.col(features)))
    made = keyed.groupBy("_content", *by, features).agg(*[F.sum(c).alias(c) for c in sums])
    return made.repartition("_content", *by).sortWithinPartitions("_content", *by).drop("_content")


# --- bug classifier ----------------------------------------------------------------------------

# Up to this many places of the vectors in use, a fit sees these places only: all others would weigh 0.
FEW_PLACES = 4096


def places_in_use(rows: DataFrame) -> list[int] | None:
    """The places where any vector is not 0, if they are few; None if a fit should see whole vectors."""
    held = rows.select(Summarizer.numNonZeros(F.col("features"))).head()[0]
    if held is None:
        return None
    found = held.toArray().nonzero()[0].tolist()
    return found or [0] if len(found) <= FEW_PLACES else None


def at_places(df: DataFrame, places: list[int] | None) -> DataFrame:
    """``df`` with only these places of ``features``."""
    if places is None:
        return df
    slicer = VectorSlicer(inputCol="_whole", outputCol="features", indices=places)
    return slicer.transform(df.withColumnRenamed("features", "_whole")).drop("_whole").withMetadata("features", {})


@dataclass
class BugModel:
    """A fitted regression and the places of the vectors that it sees."""

    fitted: LogisticRegressionModel
    places: list[int] | None

    @property
    def intercept(self) -> float:
        own = self.fitted
        return float(own.coefficients[-1]) if own.getFeaturesCol() == WITH_ONE else own.intercept

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction and its probability."""
        made = at_places(df.withColumn("_given", F.col("features")), self.places)
        made = with_one(made) if self.fitted.getFeaturesCol() == WITH_ONE else made
        scored = self.fitted.transform(made).drop("features", WITH_ONE)
        return scored.withColumnRenamed("_given", "features")


@dataclass
class BugClassifier:
    """The fitted model, the estimator to refit it with, and its cross-validation scores.

    A score is (inverse strength, class weight, mean F1, its deviation, chosen, solver).
    """

    model: BugModel
    estimator: LogisticRegression
    strength: float
    scores: list[tuple[float, str, float, float, int, str]]


def with_one(df: DataFrame) -> DataFrame:
    """Add the features with a constant one behind them, as ``features_and_one``."""
    both = VectorAssembler(inputCols=["features", "_one"], outputCol=WITH_ONE)
    made = both.transform(df.withColumn("_one", F.lit(1.0))).drop("_one")
    return made.withMetadata(WITH_ONE, {})  # else every plan carries a name for each of 2 ** 18 places


def solver_rows(df: DataFrame) -> DataFrame:
    """Weighted rows as both solvers need them: each with its mirror image, features negated and class swapped.

    A row and its mirror image have the same logistic loss without a free intercept, so a fit on both is
    the fit on the rows; but the constant feature, which Spark would leave out, takes two values. Mirror
    images weigh nothing in ``unit`` and ``balanced``; in the columns ``<weight>_mirrored`` they weigh as their rows.
    """
    rows = with_one(df).withColumns({f"{w}_mirrored": F.col(w) for w in WEIGHTS})
    size = rows.select(F.col(WITH_ONE)).head()
    if size is None:
        return rows
    negative = ElementwiseProduct(scalingVec=[-1.0] * size[0].size, inputCol=WITH_ONE, outputCol="_negated")
    mirrored = negative.transform(rows).withMetadata("_negated", {}).withColumns({
        "label": 1.0 - F.col("label"), **{w: F.lit(0.0) for w in WEIGHTS}, WITH_ONE: F.col("_negated"),
    })
    return rows.unionByName(mirrored.drop("_negated"))


def _solver_params(base: LogisticRegression, weight: str, solver: str) -> dict:
    penalised = SOLVERS[solver]
    return {
        base.weightCol: f"{weight}_mirrored" if penalised else weight, base.fitIntercept: not penalised,
        base.featuresCol: WITH_ONE if penalised else "features",
    }


def with_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Add ``unit`` and ``balanced`` weights; balanced gives every class the same total."""
    sizes = train.groupBy(label).agg(row_count().alias("_n"))
    total, classes = sizes.agg(F.sum("_n")).scalar(), sizes.agg(row_count()).scalar()
    weights = sizes.select(label, (total / (classes * F.col("_n"))).alias("balanced"))
    return train.join(F.broadcast(weights), label).withColumn("unit", F.lit(1.0))  # a row a class


def fit_bug_classifier(
    train: DataFrame, key: str, grid: list[float] | None = None, folds: int = 5, seed: int = 42,
    parallelism: int = 8,
) -> BugClassifier:
    """Logistic regression on (``features``, ``label``), chosen by F1 of class 1.

    The grid crosses inverse strength with class weights and solvers: ``lbfgs`` leaves the intercept
    free, ``liblinear`` penalises it like a weight, as a constant feature. Folds are stratified by hash
    over all rows; then rows of equal features, label and fold shrink to one of their summed weight. The
    scores are those of the folds, taken before the final fit on all rows; the first best is chosen.
    """
    strengths = grid or V.GRID_C
    folded = stratified_folds(with_weights(train), "label", key, folds, seed)
    rows = folded.select("features", F.col("label").cast("double").alias("label"), "fold", "unit", "balanced")
    small = materialise(shrunk(rows, ["label", "fold"], [*WEIGHTS]), "shrunk-rows")
    places = places_in_use(small)
    data = materialise(solver_rows(at_places(small, places)), "classifier-rows")
    per_fold = _row_total(data) * (folds - 1) / folds
    base = LogisticRegression(maxIter=MAX_ITERATIONS, tol=TOLERANCE, standardization=False)
    settings = [(c, weight, solver) for c in strengths for weight in WEIGHTS for solver in SOLVERS]
    params = [
        {base.regParam: 1.0 / (c * per_fold), **_solver_params(base, weight, solver)} for c, weight, solver in settings
    ]
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, weightCol="unit")
    search = CrossValidator(
        estimator=base, estimatorParamMaps=params, evaluator=f1, numFolds=folds, foldCol="fold",
        seed=seed, parallelism=parallelism,
    ).fit(data)
    best = max(range(len(params)), key=lambda i: search.avgMetrics[i])
    scores = [
        (c, weight, float(search.avgMetrics[i]), float(search.stdMetrics[i]), int(i == best), solver)
        for i, (c, weight, solver) in enumerate(settings)
    ]
    chosen = {param: value for param, value in params[best].items() if param != base.regParam}
    return _fit_all(base.copy(chosen), settings[best][0], scores, data, places)


def _row_total(data: DataFrame) -> float:
    """The rows that shrunk data stands for."""
    return data.agg(F.sum("unit")).first()[0] or 0.0


def _fit_all(estimator, strength, scores, data: DataFrame, places: list[int] | None) -> BugClassifier:
    """Fit on all rows of ``data``, the regularisation scaled to their number."""
    scaled = estimator.copy({estimator.regParam: 1.0 / (strength * _row_total(data))})
    return BugClassifier(BugModel(scaled.fit(data), places), scaled, strength, scores)


def refit(found: BugClassifier, rows: DataFrame) -> BugClassifier:
    """The chosen settings on other rows (``features``, ``label``)."""
    weighted = with_weights(rows.select("features", F.col("label").cast("double").alias("label")))
    small = materialise(shrunk(weighted, ["label"], [*WEIGHTS]), "shrunk-rows")
    places = places_in_use(small)
    data = materialise(solver_rows(at_places(small, places)), "refit-rows")
    return _fit_all(found.estimator, found.strength, found.scores, data, places)


def train_and_evaluate(
    rows: DataFrame, key: str, grid: list[float] | None = None, frac: float = 0.75, seed: int = 42
) -> tuple[BugClassifier, DataFrame]:
    """Search on the training share, report on the held-out share, then fit the choice on all rows.

    The report is made before the last fit, which sees the held-out rows.
    """
    split = materialise(stratified_split(rows, "label", key, frac, seed), "split-rows")
    found = fit_bug_classifier(split.filter("is_train = 1"), key, grid, seed=seed)
    held = found.model.transform(split.filter("is_train = 0"))
    return refit(found, split), classification_report(held, "label", "prediction")


def pseudo_labels(
    scored: DataFrame, high: float = V.PSEUDO_BUG, low: float = V.PSEUDO_FEEDBACK
) -> DataFrame:
    """The confident rows with their ``label``: 1 above ``high``, 0 below ``low``."""
    p = F.col("bug_confidence")
    return scored.withColumn("label", F.when(p > high, 1).when(p < low, 0)).dropna(subset=["label"])


def self_train(
    found: BugClassifier, train: DataFrame, pool: DataFrame, text: str = "processed_review",
    high: float = V.PSEUDO_BUG, low: float = V.PSEUDO_FEEDBACK,
) -> BugClassifier:
    """Add the confident rows of ``pool`` to ``train`` and fit again; unchanged if there is none."""
    scored = score_reviews(found.model, pool.filter(F.col(text) != ""), text)
    pseudo = materialise(pseudo_labels(scored, high, low).select("features", "label"), "pseudo-labels")
    if pseudo.isEmpty():
        return found
    return refit(found, train.select("features", F.col("label").cast("int")).union(pseudo))


def score_reviews(
    model: BugModel, df: DataFrame, text: str = "processed_review"
) -> DataFrame:
    """Add ``is_bug_report`` and ``bug_confidence``; an empty text is 0 with 0.0."""
    empty = F.col(text) == ""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.when(empty, 0).otherwise(F.col("prediction").cast("int")).alias("is_bug_report"),
        F.when(empty, 0.0).otherwise(vector_to_array("probability")[1]).alias("bug_confidence"),
    )


def prediction_table(reviews: DataFrame) -> DataFrame:
    """Reviews with cleaned text, text features and imputed ratings, ready to be scored."""
    clean = X.clean_spaced(F.col("review_description"))
    chars, words = X.text_lengths(F.col("processed_review"))
    return reviews.withColumns({"review_description": clean}).withColumns(
        {"processed_review": F.col("review_description")}
    ).withColumns({
        "review_length": chars,
        "word_count": words,
        "bug_keyword_count": X.keyword_count(F.col("processed_review")),
    })


# --- the rest without a keyword ----------------------------------------------------------------

def _with_clean_features(bugs: DataFrame, embedder: Callable | None = None, vectors: str | None = None) -> DataFrame:
    cleaned = bugs.withColumn("cleaned_text", X.clean_stripped(F.col("review_description")))
    made = text_features(cleaned, "cleaned_text", embedder, vectors=vectors)
    return made.drop(vectors) if vectors else made


def cluster_other(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``cluster`` to rows that carry ``features``; at most as many as there are distinct vectors.

    The fit sees distinct vectors, each weighing as many rows as share it, dealt and sorted by content:
    a text that many rows repeat is one row of it, and the start does not depend on how the input was cut.
    Each distinct vector is also given its cluster once, and rows take it by content: near a centre Spark
    goes through all places of a vector, which is dear if millions of rows do so.
    """
    weighed = materialise(shrunk(df.select("features", F.lit(1.0).alias("weight")), [], ["weight"]), "distinct-vectors")
    distinct = weighed.limit(k).count()
    if distinct < 2:
        return df.withColumn("cluster", F.lit(0))
    model = KMeans(
        k=distinct, seed=seed, maxIter=CLUSTER_ITERATIONS, featuresCol="features", predictionCol="cluster", weightCol="weight"
    ).fit(weighed)
    named = materialise(model.transform(weighed).select(content_of(F.col("features")).alias("_content"), "cluster"), "vector-clusters")
    placed = df.withColumn("_content", content_of(F.col("features"))).join(named, "_content")
    return placed.select(*df.columns, "cluster")


def reclassify_other(
    bugs: DataFrame, k: int = 5, seed: int = 42, embedder: Callable | None = None, vectors: str | None = None,
) -> DataFrame:
    """Give every ``Other`` row the category that keyword-labelled rows suggest, and a cluster.

    Rows with a null category are neither learnt from nor relabelled; they stay as they are. ``vectors``
    names a column of supplied embeddings, which is used and dropped.
    """
    rows = materialise(_with_clean_features(bugs, embedder, vectors), "reclassify-rows")
    kept, other = split_other(rows)
    base = kept.drop("features").withColumns({
        "predicted_category": F.lit(None).cast("string"), "cluster": F.lit(None).cast("int"),
    })
    labelled = kept.filter("bug_category IS NOT NULL")
    named_rows = bounded_rows(labelled.select("bug_category").distinct())
    if named_rows is None:
        raise ValueError("too many categories to learn: one coefficient row each would not fit")
    categories = sorted(r[0] for r in named_rows)
    if not categories or other.isEmpty():
        return base.unionByName(other.drop("features"), allowMissingColumns=True)
    names = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=categories)
    if len(categories) == 1:
        named = cluster_other(other, k, seed).withColumn("predicted_category", F.lit(categories[0]))
        relabelled = named.withColumn("bug_category", F.col("predicted_category"))
        return base.unionByName(relabelled.select(*base.columns))
    index = StringIndexerModel.from_labels(categories, inputCol="bug_category", outputCol="label")
    weighed = shrunk(labelled.select("features", "bug_category", F.lit(1.0).alias("unit")), ["bug_category"], ["unit"])
    train = materialise(index.transform(weighed).select("features", "label", "unit"), "relabel-rows")
    model = LogisticRegression(
        family="multinomial", maxIter=MAX_ITERATIONS, tol=TOLERANCE, standardization=False, weightCol="unit",
        regParam=1.0 / _row_total(train),
    ).fit(train)
    clustered = cluster_other(other, k, seed)
    named = names.transform(model.transform(clustered))
    relabelled = named.withColumn("bug_category", F.col("predicted_category"))
    return base.unionByName(relabelled.select(*base.columns))
