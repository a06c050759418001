"""The daily chain: feed, predictions, categories, re-labelling, developer rollup, digest.

Every step is a function from DataFrames to DataFrames; ``run_daily`` stores a step's table and
hands the stored table to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import schemas as S
from ticketloom.functions import text as X
from ticketloom.operators import ingest, language, models, rollup, state, tickets
from ticketloom.operators.ingest import available_columns, require_columns
from ticketloom.operators.lookup import severity_table, small_table, taxonomy_rules
from ticketloom.operators.taxonomy import categorize
from ticketloom.session import materialise, scratch_scope
from ticketloom.sources.readers import path_exists
from ticketloom.sources.versions import current, read_current, update, write_next


def predict_bugs(
    reviews: DataFrame, training: DataFrame, grid: list[float] | None = None, embedder: Callable | None = None,
    training_vectors: str | None = None, review_vectors: str | None = None,
) -> tuple[DataFrame, DataFrame, list[tuple]]:
    """Clean, featurise, fit with self-training, score every review.

    Also gives the held-out report and the cross-validation scores on the labelled rows, where the
    chosen settings, with which self-training fits again, are marked. Features are hashed words unless
    an ``embedder`` or columns of supplied vectors are given. The featurised reviews are stored once.
    """
    prepared = ingest.impute_rating(models.prediction_table(reviews))
    labelled = training.select(
        X.clean_spaced(F.col("review")).alias("processed_review"), F.col("label").cast("int"),
        *([training_vectors] if training_vectors else []),
    )
    # numbered once and stored: copies of a text differ, and a repeated task sees the same numbers
    numbered = materialise(labelled.withColumn("row_key", F.monotonically_increasing_id()), "training")
    if embedder is None and review_vectors is None:
        featurizer = models.fit_text_features(prepared, "processed_review")
        features = lambda df, vectors: models.text_features(df, "processed_review", model=featurizer)
    else:
        features = lambda df, vectors: models.text_features(df, "processed_review", embedder, vectors=vectors)
    pool = materialise(features(prepared, review_vectors), "pool")
    train = materialise(features(numbered, training_vectors).select("row_key", "processed_review", "label", "features"), "train")
    found, report = models.train_and_evaluate(train, "row_key", grid)
    final = models.self_train(found, train, pool)
    scored = models.score_reviews(final.model, pool)
    return available_columns(scored, S.BUG_PREDICTIONS.names), report, found.scores


def with_vectors(df: DataFrame, vectors: DataFrame, key: str = "review_id") -> DataFrame:
    """Add ``_vector`` from ``vectors(review_id, vector)``, zeros where there is none; of several the least counts."""
    one = vectors.dropna().groupBy(key).agg(F.min("vector").alias("_vector"))
    length = vectors.agg(F.max(F.size("vector"))).scalar()
    zeros = F.array_repeat(F.lit(0.0), F.greatest(length, F.lit(0)))
    return df.join(one, key, "left").withColumn("_vector", F.coalesce(F.col("_vector").cast("array<double>"), zeros))


def categorize_bugs(predictions: DataFrame, rules: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Bugs with their keyword category, in the ``categorized_bugs`` columns, and ``also`` others."""
    require_columns(predictions, ["review_description", "review_date", "app_version"])
    found = categorize(tickets.bugs_only(predictions), "review_description", rules, cleaned=True)
    return found.select(*S.CATEGORIZED_BUGS.names, *also)


def prepare_digest(spark: SparkSession, tickets_: DataFrame, path: str, first_n: int = 10) -> tuple[DataFrame, str]:
    """The rows to send, stored, and the folder that names this digest to ``confirm_digest``.

    Nothing counts as sent yet. Until a digest is confirmed the next one holds its tickets again, so a
    sender that dies loses none. ``path`` holds ``digest`` and ``sent_tickets`` in versions, and
    ``digest_keys`` with what each digest would count as sent.
    """
    sent = read_current(spark, f"{path}/sent_tickets", S.SENT_TICKETS)
    rows, after = state.digest(tickets_, sent, first_n)
    folder = write_next(rows, f"{path}/digest")
    # the number is this digest's own; what an earlier run left under it is replaced
    fresh = after.join(sent.dropna(subset=["ticket_key"]), "ticket_key", "left_anti")
    fresh.select(*S.SENT_TICKETS.names).write.mode("overwrite").parquet(_keys_of(folder, path))
    return spark.read.schema(rows.schema).parquet(folder), folder


def _keys_of(folder: str, path: str) -> str:
    return f"{path}/digest_keys/{folder.rsplit('/', 1)[1]}"


def confirm_digest(spark: SparkSession, folder: str, path: str) -> str:
    """Count the tickets of the digest in ``folder`` as sent, once it is out. Returns the sent table's folder.

    May be repeated, may come after a later digest was prepared, and may run beside another confirmation.
    """
    keys = _keys_of(folder, path)
    if not path_exists(spark, f"{keys}/_SUCCESS"):
        raise ValueError(f"{folder} was not prepared to its end; prepare the digest again")
    made = spark.read.schema(S.SENT_TICKETS).parquet(keys)
    add = lambda sent: state.sent_keys(sent.unionByName(made)).orderBy("ticket_id", "ticket_key")
    return update(spark, f"{path}/sent_tickets", S.SENT_TICKETS, add)


def deliver_digest(
    spark: SparkSession, tickets_: DataFrame, path: str, first_n: int = 10, send: Callable[[DataFrame], None] | None = None,
) -> tuple[DataFrame, str]:
    """Prepare the digest, hand its rows to ``send``, and confirm it when that returns.

    Without ``send`` the stored rows are the delivery. Gives them and the folder of the sent table.
    """
    rows, folder = prepare_digest(spark, tickets_, path, first_n)
    if send is not None:
        send(rows)
    return rows, confirm_digest(spark, folder, path)


def attend(spark: SparkSession, wanted: DataFrame, at, path: str) -> str:
    """Add the tickets not yet in the attended table as its next version; calls at once both take effect."""
    return update(
        spark, f"{path}/attended_tickets", S.ATTENDED_TICKETS, lambda attended: state.mark_attended(attended, wanted, at)
    )


def summarise(bugs: DataFrame, model: Callable, key: str, parsed: bool = True) -> DataFrame:
    """Report fields of every category from a model over its sample, prompt included."""
    context = rollup.summary_context(bugs, numbered=parsed, key=key)
    prompted = rollup.summary_prompt(context).select("bug_category", F.col("prompt").alias("context"))
    return rollup.summary_sections(rollup.summarise_with(prompted, model), parsed=parsed)


def run_daily(
    spark: SparkSession, raw: DataFrame, training: DataFrame, out: str, grid: list[float] | None = None,
    embedder: Callable | None = None, summariser: Callable | None = None, parsed: bool = True,
    translations: DataFrame | None = None, send: Callable[[DataFrame], None] | None = None,
    training_vectors: str | None = None, review_vectors: DataFrame | None = None,
) -> dict[str, str]:
    """Run the chain and store each table as parquet below ``out``; gives the folders by name.

    ``raw`` must not come back empty: history is kept then. Reviews, the digest and the sent tickets
    are kept in versions, so a run that dies leaves the last complete one. ``translations`` (review_id,
    translated) adds a table of translated reviews; ``summariser`` fills the developer summaries. ``send``
    gets the digest's rows; they count as sent when it returns. Supplied vectors: ``training_vectors``
    names their column in ``training``, ``review_vectors`` is a table (review_id, vector).
    """
    paths = {}
    with scratch_scope(spark):
        def store(name: str, df: DataFrame) -> DataFrame:
            paths[name] = f"{out}/{name}"
            df.write.mode("overwrite").parquet(paths[name])
            return spark.read.schema(df.schema).parquet(paths[name])

        incoming = ingest.normalize_feed(raw)
        if incoming.isEmpty():
            raise ValueError("the feed is empty; stored reviews are kept")
        history = read_current(spark, f"{out}/reviews", incoming.schema)
        paths["reviews"] = write_next(ingest.upsert_latest(history, incoming), f"{out}/reviews")
        reviews = spark.read.schema(incoming.schema).parquet(paths["reviews"])
        if translations is not None:
            tagged = language.language_tag(reviews, "review_description", "language_code")
            store("translated_reviews", language.translation_route(tagged, "review_description", translations))

        given = None if review_vectors is None else "_vector"
        known = reviews if given is None else with_vectors(reviews, review_vectors)
        scored, report, scores = predict_bugs(known, training, grid, embedder, training_vectors, given)
        store("classifier_report", report)
        store("classifier_scores", small_table(spark, scores, S.CLASSIFIER_SCORES))
        predictions = store("bug_predictions", scored)
        store("prioritized_bugs", tickets.prioritize(predictions))
        categorized = store("categorized_bugs", categorize_bugs(predictions, taxonomy_rules(spark)))
        if given is not None:
            keyed = materialise(categorize_bugs(predictions, taxonomy_rules(spark), ("review_id",)), "keyed-bugs")
            categorized = with_vectors(keyed, review_vectors).drop("review_id")
        relabelled = store("reclassified_bugs", models.reclassify_other(categorized, embedder=embedder, vectors=given))
        severity = severity_table(spark)
        board = store("tickets", tickets.tickets(relabelled, severity))
        _, paths["sent_tickets"] = deliver_digest(spark, board, out, send=send)
        paths["digest"] = current(spark, f"{out}/digest")
        sections = None
        if summariser is not None:
            keyed = board.select("ticket_key", "review_description", "bug_category", "review_date", "app_version")
            sections = store("report_sections", summarise(keyed, summariser, "ticket_key", parsed))
        per_category = rollup.developer_rollup(relabelled, severity)
        store("developer_bug_summaries", rollup.order_by_priority(
            rollup.developer_summaries(per_category, sections)).drop("priority_rank"))
    return paths
