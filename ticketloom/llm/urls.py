"""URL filters in time: dated list entries become validity intervals, captures are judged as of their fetch.

A list is a log of entries: at a time, a pattern is added to a list or removed from it. The log of one
pattern becomes disjoint intervals in which it holds. A capture's URL gives the patterns that could
match it: its host and every parent domain, its host with every prefix of its path that ends at a
slash, and the page itself, its host with the whole path, without and with the query. Hosts go by lower
case, paths by their own. Captures meet intervals by an equality join on the pattern, with the fetch time inside the
interval; a pattern of a list holds in at most one interval at a time, so a capture gets at most one
row for each list and pattern of its own. A block counts unless a longer pattern of an allow list holds.

Times equal: a removal comes after an addition, so the pattern does not hold. Repeated entries count
once. Null or malformed URLs match nothing; null fetch times neither. Rows that repeat are judged
alike. Empty captures give an empty result, an empty list blocks nothing. Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port, final dot; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.lower(F.rtrim(host, F.lit(".")))


def patterns_of(url: Column) -> Column:
    """Every pattern that could match a URL: domains, host with path prefixes, host with path and query."""
    host = host_of(url)
    labels = F.split(host, "\\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    asked = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^#]*)", 1)
    parts = F.split(path, "/")
    prefixes = F.when(
        F.size(parts) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    pages = F.when(path != "", F.array(F.concat(host, path), F.concat(host, asked))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes, pages))).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) of (list, pattern) from entries (list, pattern, action, at)."""
    host = F.substring_index("pattern", "/", 1)
    folded = F.concat(F.lower(host), F.substring("pattern", F.length(host) + 1, F.length("pattern")))
    log = entries.select("list", folded.alias("pattern"), "action", "at").dropna().distinct()
    order = Window.partitionBy("list", "pattern").orderBy("at", "action")  # add before remove
    ended = log.withColumn("valid_to", F.lead("at").over(order))
    return ended.filter("action = 'add' AND (valid_to IS NULL OR valid_to > at)").select(
        "list", "pattern", F.col("at").alias("valid_from"), "valid_to"
    )


def verdicts(captures: DataFrame, entries: DataFrame, allow_lists: list[str], url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Each distinct (url, fetch time) with ``lists``, ``pattern`` (the longest block) and ``blocked``.

    Captures of one URL at one time are judged once. The hot host's rows meet few intervals; skewed
    partitions of captures are split by adaptive execution, because the join is a plain inner one.
    """
    asked = captures.select(F.col(url).alias("url"), F.col(at).alias("at")).dropna().distinct()
    open_ = asked.withColumn("pattern", F.explode(patterns_of(F.col("url"))))
    held = open_.join(validity(entries), "pattern").filter(
        (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    )
    allowed = F.col("list").isin(allow_lists) if allow_lists else F.lit(False)
    longest = lambda wanted: F.max(F.when(wanted, F.struct(F.length("pattern").alias("n"), F.col("pattern"))))
    grouped = held.groupBy("url", "at").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        longest(~allowed).alias("block"), longest(allowed).alias("allow"),
    )
    blocks = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("allow.n") <= F.col("block.n")))
    return grouped.select("url", "at", "lists", F.col("block.pattern").alias("pattern"), blocks.alias("blocked"))


def filter_captures(captures: DataFrame, entries: DataFrame, keep: list[str], allow_lists: list[str], url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``keep`` of every capture with ``lists`` (empty if none), ``pattern`` and ``blocked``.

    A column of these names in ``keep`` gives way to the result.
    """
    keep = [c for c in keep if c not in ("lists", "pattern", "blocked")]
    judged = verdicts(captures, entries, allow_lists, url, at).select(
        F.col("url").alias("_url"), F.col("at").alias("_at"), F.col("lists").alias("_lists"), F.col("pattern").alias("_pattern"),
        F.col("blocked").alias("_blocked"),
    )
    rows = captures.select(*keep, F.col(url).alias("_u"), F.col(at).alias("_t"))
    return rows.join(judged, (F.col("_u") == F.col("_url")) & (F.col("_t") == F.col("_at")), "left").select(
        *keep,
        F.coalesce("_lists", F.lit("")).alias("lists"), F.coalesce("_pattern", F.lit("")).alias("pattern"),
        F.coalesce("_blocked", F.lit(False)).alias("blocked"),
    )
