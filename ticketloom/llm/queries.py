"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import (
    bpe, chat, fingerprints, hard_negatives, importance, mixing, near_duplicates, packing, quality, sharding, substrings,
    tokenize, urls,
)
from ticketloom.session import materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_fingerprints(spark, sf):
    made = fingerprints.fingerprints(table(spark, sf, "documents"))
    paired = fingerprints.with_next(made, "doc_id", ["text", "fingerprint"])
    edited = paired.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text")))
    both = edited.withColumn("edited_packed", fingerprints.fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_hex(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_packed")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


@query
def op2_substring_dedup(spark, sf):
    made = substrings.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# Two block lists and an allow list, as a log: hosts of the crawl come and go, by their first page.
LIST_EPOCH = "2024-01-01"
ALLOW_LISTS = ["partners"]


def captures(spark, sf):
    """Pages, fetched one every ten minutes in the order of their ids, starting over every 180 days."""
    minutes = F.col("page_id") % 25_920 * 10
    at = F.timestamp_add("MINUTE", minutes.cast("int"), F.lit(LIST_EPOCH).cast("timestamp_ntz"))
    return table(spark, sf, "pages").select("page_id", "url", at.alias("fetched_at"))


def list_entries(spark, sf):
    """The log of the lists, made from the hosts of the pages: every host is listed at some time.

    By the host's first page: a third is on ``spam`` for days 10 to 100 and again from day 120 on, a
    third on ``adult`` from day 30 on, a third is never blocked itself; one directory of a host is on
    ``adult`` until day 90; every fifth host is on ``partners`` from day 60 on.
    """
    hosts = captures(spark, sf).groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.min("page_id").alias("first"))
    hosts = hosts.filter("host <> ''")
    day = lambda n: F.timestamp_add("DAY", F.lit(n), F.lit(LIST_EPOCH).cast("timestamp_ntz"))
    plan = [
        ("first % 3 = 0", "spam", F.col("host"), "add", 10), ("first % 3 = 0", "spam", F.col("host"), "remove", 100),
        ("first % 3 = 0", "spam", F.col("host"), "add", 120), ("first % 3 = 1", "adult", F.col("host"), "add", 30),
        ("true", "adult", F.concat("host", F.lit("/de/")), "add", 0),
        ("true", "adult", F.concat("host", F.lit("/de/")), "remove", 90),
        ("first % 5 = 0", "partners", F.col("host"), "add", 60),
    ]
    rows = F.array(*[
        F.when(F.expr(who), F.struct(
            F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("at")
        )) for who, name, pattern, action, n in plan
    ])
    return hosts.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


@query
def op3_url_filters(spark, sf):
    return urls.filter_captures(captures(spark, sf), list_entries(spark, sf), ["page_id"], ALLOW_LISTS)


@query
def op4_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text", TOKENIZER, with_ids=False)


@query
def op5_quality_rules(spark, sf):
    measured = materialise(quality.measures(table(spark, sf, "documents"), "text", ["doc_id"]), "measures")
    judged = quality.judge(measured, quality.fit(measured))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query
def op6_near_duplicates(spark, sf):
    return near_duplicates.classes(table(spark, sf, "documents"))


@query
def op7_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], rows.schema)
    return chat.read_back(chat.segments(rows.unionByName(more), "conv_id", "turn", "role", "text"), "conv_id")


@query
def op8_token_counts(spark, sf):
    counted = tokenize.token_counts(table(spark, sf, "documents"), "text", TOKENIZER, ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op9_shards(spark, sf):
    made = sharding.shards(table(spark, sf, "documents"))
    return made.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op10_source_mix(spark, sf):
    mixed = mixing.mix(
        table(spark, sf, "documents"), mixing.default_margins(), share=mixing.SHARE, tokenizer=TOKENIZER,
        keep=["doc_id", "source", "lang"],
    )
    return mixed.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("tokens"),
        F.round("_probability", 9).alias("probability"), F.col("_sampled").alias("sampled"),
        F.round("_margin_error", 9).alias("margin_error"),
    )


@query
def op11_importance(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


@query
def op12_bpe(spark, sf):
    docs = table(spark, sf, "documents")
    coded = bpe.encode(docs, "text", RANK_FILE, public_tokenizers.PATTERN, ["doc_id"])
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    digested = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"))
    return bpe.decode(digested, "ids", RANK_FILE).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op13_hard_negatives(spark, sf):
    rows = table(spark, sf, "embeddings")
    x = lambda v: v.cast("double")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    made = rows.filter(finite).select(
        "vec_id", label.alias("label"), F.transform("embedding", lambda v: F.floor(256 * x(v))).alias("vector")
    )
    return hard_negatives.mine(made, "vec_id", "vector", "label", F.col("vec_id") % 100 == 0)
