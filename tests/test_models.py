"""Models: planted data reach their score, seeds give the same result, splits are exact."""

from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketloom.operators import models, phrases

WORDS_BAD = ["crash", "error", "broken", "freeze"]
WORDS_GOOD = ["great", "love", "nice", "perfect"]


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, f"the app {(WORDS_BAD if i % 2 else WORDS_GOOD)[i // 2 % 4]} today", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, processed_review string, label int")
    return models.text_features(df, "processed_review").cache()


@pytest.fixture(scope="module")
def found(train):
    return models.fit_bug_classifier(train, "id", grid=[1.0, 100.0], folds=3)


def test_classifier_separates(train, found):
    assert len(found.scores) == 8 and {s[5] for s in found.scores} == {"liblinear", "lbfgs"} and sum(s[4] for s in found.scores) == 1
    best = next(s for s in found.scores if s[4])
    assert best[2] > 0.95
    scored = models.score_reviews(found.model, train)
    assert scored.filter("is_bug_report <> label").count() == 0


def test_report_is_on_held_out_rows(train):
    final, report = models.train_and_evaluate(train, "id", grid=[10.0])
    found = {r["class"]: r for r in report.collect()}
    assert found["accuracy"].support == 20 and found["1"].support == 10
    assert found["accuracy"].f1 == 1.0
    assert models.score_reviews(final.model, train).filter("is_bug_report <> label").count() == 0


def test_same_seed_same_model(train, found):
    again = models.fit_bug_classifier(train, "id", grid=[1.0, 100.0], folds=3)
    assert [s[:2] for s in again.scores] == [s[:2] for s in found.scores]
    assert abs(again.model.intercept - found.model.intercept) < 1e-6


def test_empty_text_scores_zero(spark, train, found):
    df = spark.createDataFrame([("",), ("crash error",)], "processed_review string")
    made = models.text_features(df, "processed_review")
    rows = {r.processed_review: r for r in models.score_reviews(found.model, made).collect()}
    assert (rows[""].is_bug_report, rows[""].bug_confidence) == (0, 0.0)
    assert sum(made.filter("processed_review = ''").select(vector_to_array("features")).first()[0]) == 0


def test_self_training(train, found):
    assert models.self_train(found, train, train, high=2.0, low=-1.0) is found
    again = models.self_train(found, train, train, high=0.6, low=0.4)
    assert models.score_reviews(again.model, train).filter("is_bug_report <> label").count() == 0


def test_split_is_exact_per_class(spark):
    # two thirds of the rows are in one class
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(0).alias("label"))
    made = models.stratified_split(df, "label", "id")
    shares = {r.label: (r.n, r.t) for r in made.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_train").alias("t")).collect()}
    assert shares == {0: (1000, 750), 1: (2000, 1500)}
    ranked = models.ranked_by_hash(df, "label", "id")
    for label, size in ((0, 1000), (1, 2000)):
        ranks = sorted(r._rank for r in ranked.filter(F.col("label") == label).collect())
        assert ranks == list(range(1, size + 1))
    shuffled = models.stratified_split(df.repartition(9), "label", "id")
    assert made.exceptAll(shuffled).count() == 0


def test_embedder_slot(spark):
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [float(len(t)), 1.0])

    df = spark.createDataFrame([("abc",), ("",)], "t string")
    rows = models.text_features(df, "t", embedder=embed).select("t", vector_to_array("features").alias("f")).collect()
    assert {r.t: r.f for r in rows} == {"abc": [3.0, 1.0], "": [0.0, 0.0]}


BUGS = "review_description string, bug_category string, review_date timestamp_ntz, app_version string"


def test_reclassify(spark):
    rows = [(f"payment card {i}", "Payment Issue", None, "1") for i in range(12)]
    rows += [(f"server gone {i}", "Server Error", None, "1") for i in range(12)]
    rows += [("card lost", "Other", None, None), ("gone gone", "other", None, None), ("???", "Other", None, None)]
    made = models.reclassify_other(spark.createDataFrame(rows, BUGS), k=2)
    assert made.count() == 27 and made.filter("lower(bug_category) = 'other'").count() == 0
    named = {r.review_description: r for r in made.collect()}
    assert named["card lost"].bug_category == named["card lost"].predicted_category == "Payment Issue"
    assert named["gone gone"].bug_category == "Server Error" and named["gone gone"].cluster in (0, 1)
    assert named["payment card 1"].predicted_category is None and named["payment card 1"].cluster is None


def test_reclassify_without_labels_or_others(spark):
    only = spark.createDataFrame([("x", "Other", None, None)], BUGS)
    assert models.reclassify_other(only).first().bug_category == "Other"
    none = spark.createDataFrame([("x", "UI Issue", None, None)], BUGS)
    assert models.reclassify_other(none).first().cluster is None


@pytest.mark.parametrize("texts,k,expected", [(["same"] * 6, 2, 1), (["a", "b", "c", "c"], 5, 3), ([""] * 3, 5, 1)])
def test_fewer_distinct_texts_than_clusters(spark, texts, k, expected):
    made = models.cluster_other(models.text_features(spark.createDataFrame([(t,) for t in texts], "t string"), "t"), k=k)
    assert made.count() == len(texts) and made.select("cluster").distinct().count() == expected


def test_null_categories_are_kept(spark):
    rows = [("a", None, None, None), ("b", "UI Issue", None, None), ("c", "Other", None, None)]
    made = {r.review_description: r.bug_category for r in models.reclassify_other(spark.createDataFrame(rows, BUGS)).collect()}
    assert made == {"a": None, "b": "UI Issue", "c": "UI Issue"}


def test_supplied_vectors(spark):
    df = spark.createDataFrame([("abc", [0.5, 1.0]), ("", [3.0, 4.0])], "t string, v array<float>")
    found = models.text_features(df, "t", vectors="v").select("t", vector_to_array("features").alias("f"))
    assert {r.t: r.f for r in found.collect()} == {"abc": [0.5, 1.0], "": [0.0, 0.0]}


def test_topics_do_not_depend_on_partitions(spark):
    words = "pay card bill bank server down gone slow great love nice app".split()
    df = spark.range(120).select(F.concat_ws(" ", *[
        F.get(F.array(*map(F.lit, words)), ((F.col("id") * (i + 3)) % len(words)).cast("int")) for i in range(4)
    ]).alias("cleaned_text"))
    runs = [phrases.topics(df.repartition(n), k=3, words=4).collect() for n in (3, 7)]
    assert runs[0] == runs[1]


def test_key_phrases_by_hand(spark):
    df = spark.createDataFrame([("good app good",), ("bad app",), ("",), ("a i",)], "cleaned_text string")
    found = {r.term: r.importance for r in phrases.key_phrases(df).collect()}
    assert set(found) == {"good", "app", "bad", "good app", "app good", "bad app"}
    import math

    once, twice = math.log(5 / 2) + 1, math.log(5 / 3) + 1
    first = math.sqrt((2 * once) ** 2 + twice ** 2 + 2 * once ** 2)
    second = math.sqrt(2 * once ** 2 + twice ** 2)
    assert found["good"] == pytest.approx(2 * once / first)
    assert found["app"] == pytest.approx(twice / first + twice / second)
    top = phrases.key_phrases(df, vocab=2, n=1).collect()
    assert [r.term for r in top] == ["app"]


def test_topics(spark):
    rows = [("payment card bill pay",), ("server down gone slow",)] * 20
    made = phrases.topics(spark.createDataFrame(rows, "cleaned_text string"), k=2, words=3)
    found = made.collect()
    assert [r.topic for r in found] == ["Topic 1", "Topic 2"] and all(len(r.words) == 3 for r in found)


def test_term_frequencies(spark):
    df = spark.createDataFrame([("b a a",), ("",), ("b c",)], "cleaned_text string")
    assert [tuple(r) for r in phrases.term_frequencies(df, n=2).collect()] == [("a", 2), ("b", 2)]


def rows_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "cleaned_text string")


TOPIC_TEXTS = [f"{a} {b} {c}" for a in ("pay", "card", "bill") for b in ("bank", "money", "fee") for c in ("pay", "owed")]
TOPIC_TEXTS += [f"{a} {b} {c}" for a in ("server", "down", "gone") for b in ("slow", "late", "lag") for c in ("server", "net")]


def test_topics_of_counted_texts_are_those_of_repeated_rows(spark):
    """The fit on distinct texts with counts, against the same fit on every row by itself."""
    texts = [t for i, t in enumerate(TOPIC_TEXTS) for _ in range(1 + i * 7 % 5)]
    rows, terms, idf = phrases.tfidf_rows(rows_of(spark, texts), "cleaned_text", 1000)
    counted = phrases.fit_topics(rows, len(terms), 2, 42, 10)
    each = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("n", F.lit(1).cast("long"))
    assert each.count() == len(texts) > rows.count() == len(set(TOPIC_TEXTS))
    import numpy as np

    assert np.allclose(counted, phrases.fit_topics(each, len(terms), 2, 42, 10), rtol=1e-9)
    known = {r.term: (r.tf, r.idf) for r in phrases.topic_vocabulary(rows_of(spark, texts)).collect()}
    assert {t: pytest.approx(known[t][1]) for t in terms} == dict(zip(terms, idf))
    made = phrases.topics(rows_of(spark, texts), k=2, words=4).collect()
    money, net = (set(" ".join(TOPIC_TEXTS[a:b]).split()) for a, b in ((0, 18), (18, 36)))
    assert sorted(set(r.words) <= money for r in made) == sorted(set(r.words) <= net for r in made) == [False, True]


def test_digamma():
    import numpy as np

    assert phrases.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)
    x = np.array([0.01, 0.2, 0.5, 1.7, 5.0, 30.0])
    assert np.allclose(phrases.digamma(x + 1), phrases.digamma(x) + 1 / x)


def test_topics_of_nothing(spark):
    assert phrases.topics(rows_of(spark, [])).count() == 0 and phrases.topics(rows_of(spark, ["", "a"])).count() == 0


def test_repeated_texts_are_no_hot_key(spark):
    """Ten distinct texts among 20,000 rows: what a fit sees is ten weighted rows, on no one partition."""
    df = spark.range(20_000).select(F.concat(F.lit("w"), F.least(F.col("id"), F.lit(9)).cast("string")).alias("t"))
    made = models.text_features(df, "t")
    shrunk = models.shrunk(made.select("features", F.lit(1.0).alias("weight")), [], ["weight"])
    assert sorted(r.weight for r in shrunk.select("weight").collect()) == [1.0] * 9 + [19_991.0]
    plan = shrunk._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > 0  # combined before the shuffle


def test_clusters_of_weighted_rows_are_those_of_repeated_rows(spark):
    from pyspark.ml.clustering import KMeans

    texts = [f"{a} {b}" for a in ("river", "boat") for b in ("water", "lake")] + [f"{a} {b}" for a in ("wheel", "brake") for b in ("engine", "gear")]
    df = models.text_features(rows_of(spark, [t for i, t in enumerate(texts) for _ in range(1 + i * 5 % 7)]), "cleaned_text")
    found = models.cluster_other(df, k=2).collect()
    plain = KMeans(k=2, seed=42, maxIter=300, predictionCol="cluster").fit(df).transform(df).collect()
    groups = lambda rows: {frozenset(r.cleaned_text for r in rows if r.cluster == c) for c in (0, 1)}
    assert groups(found) == groups(plain) == {frozenset(texts[:4]), frozenset(texts[4:])}


def test_the_penalised_intercept_by_hand(spark):
    """Two rows at x = 1 of both classes, two at 0: the penalised fit solves C * gradient = weights, all of them."""
    import numpy as np

    rows = [(1.0, 1), (1.0, 1), (1.0, 0), (0.0, 0), (0.0, 0), (0.0, 0)]
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense([x]), y) for i, (x, y) in enumerate(rows)], ["id", "features", "label"])
    strength = 2.0
    estimators = {}
    for solver in models.SOLVERS:
        base = models.LogisticRegression(
            maxIter=1000, tol=1e-12, standardization=False, regParam=1 / (strength * len(rows)),
        )
        weighed = models.with_weights(df.withColumn("label", F.col("label").cast("double")))
        shrunk = models.shrunk(weighed.select("features", "label", "unit", "balanced"), ["label"], ["unit", "balanced"])
        assert shrunk.count() == 3
        estimators[solver] = base.copy(models._solver_params(base, "unit", solver)).fit(models.solver_rows(shrunk))

    def gradient(slope, intercept):
        p = [1 / (1 + np.exp(-(slope * x + intercept))) for x, _ in rows]
        return strength * sum((q - y) * x for q, (x, y) in zip(p, rows)), strength * sum(q - y for q, (_, y) in zip(p, rows))

    slope, intercept = estimators["liblinear"].coefficients
    a, b = gradient(slope, intercept)
    assert a + slope == pytest.approx(0, abs=1e-6) and b + intercept == pytest.approx(0, abs=1e-6)
    slope, intercept = estimators["lbfgs"].coefficients[0], estimators["lbfgs"].intercept
    a, b = gradient(slope, intercept)
    assert a + slope == pytest.approx(0, abs=1e-6) and b == pytest.approx(0, abs=1e-6)


def test_latent_vectors_separate_groups_of_words(spark):
    """Texts of one group come near each other even where they share no word; other groups stay apart."""
    import numpy as np

    from ticketloom.operators import latent

    groups = [["river", "water", "boat", "lake"], ["engine", "wheel", "brake", "gear"], ["bread", "butter", "honey", "jam"]]
    texts = [f"{g[i % 4]} {g[(i + 1 + i // 4) % 4]}" for i in range(24) for g in groups]
    df = rows_of(spark, [*texts, "", "unknown"] * 2)
    model = latent.fit_latent(df, "cleaned_text", rank=3, more=12, vocab=12)
    made = models.text_features(df, "cleaned_text", embedder=model.embedder()).select("cleaned_text", vector_to_array("features").alias("f"))
    found = {r.cleaned_text: np.array(r.f) for r in made.collect()}
    assert not found[""].any() and not found["unknown"].any()
    like = lambda a, b: found[a] @ found[b] / np.sqrt((found[a] @ found[a]) * (found[b] @ found[b]))
    assert like("river water", "boat lake") > 0.9 and like("river water", "engine wheel") < 0.1
    # the singular values of the whole matrix, by a dense factorisation
    rows, terms, _ = phrases.tfidf_rows(df, "cleaned_text", 12)
    dense = np.array([np.bincount(r.at, r.weight, len(terms)) for r in rows.collect() for _ in range(r.n)])
    assert np.allclose(model.strengths, np.linalg.svd(dense, compute_uv=False)[:3])
    assert latent.fit_latent(df.limit(0), "cleaned_text").terms == []


def test_shrinking_sorts_no_rows_before_they_are_combined(spark):
    """Vectors are part of the key: beside it they would make every task sort all of its rows."""
    texts = spark.range(4000).select(F.concat(F.lit("text w"), F.col("id") % 3).alias("t"), (F.col("id") % 2).cast("double").alias("label"))
    made = models.shrunk(models.text_features(texts, "t").withColumn("unit", F.lit(1.0)), ["label"], ["unit"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert made.columns == ["label", "features", "unit"]
    assert made.count() == 6 and made.agg(F.sum("unit")).first()[0] == 4000.0
