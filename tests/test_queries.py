"""Every registered query: equal to the SQL engine's result, and a plan fit for scale."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL
from tools.check_oracle import TABLES, canonical

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    """Those of the training-data operators are tested beside them."""
    from checks import oracles, queries

    assert set(queries.REGISTRY) == set(oracles.oracle_sql()) | WHOLE_TEXTS and set(ORACLES) <= set(QUERIES)


# Models over whole texts: no SQL tells their rows.
WHOLE_TEXTS = {"topics_whole_text", "other_clusters_whole_text"}


def test_topics_and_clusters_of_whole_texts(spark):
    topics = QUERIES["topics_whole_text"](spark, SMALL).collect()
    assert [r.topic for r in topics] == [f"Topic {i}" for i in range(1, 6)] and all(len(set(r.words.split())) == 9 for r in topics)
    clusters = QUERIES["other_clusters_whole_text"](spark, SMALL).collect()
    assert len({r.review_id for r in clusters}) == len(clusters) and {r.cluster for r in clusters} <= set(range(5))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.toPandas()) == canonical(want)


# Queries that have run by the time they return: their plan is that of reading a stored result.
EAGER = {"categorize_large", "digest_confirmed", "digest_delivered", "stream_upsert", "stream_new_tickets", "stream_weekly_counts", "bug_classifier", "held_out_report",
         "self_training", "bug_predictions", "reclassified", "other_clusters", "topics", "csv_round_trip",
         "table_round_trip", "file_before_table"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - EAGER))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"NestedLoop|Cartesian|EvalPython|InPandas", plan)
    # a window over one partition would put the whole table into one task
    assert not re.search(r"Window \[[^\n]*\n[^\n]*\n?[^\n]*SinglePartition", plan)


@pytest.mark.parametrize("name", ["upsert_latest", "category_sample", "summary_context"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Final.*Exchange.*WindowGroupLimit.*Partial", plan, re.S)


@pytest.mark.parametrize("name,table,scans", [("key_phrases", "phrase-texts", 2), ("attended_report", "asked-tickets", 2)])
def test_stored_tables_are_read_no_more_than_needed(spark, name, table, scans):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"FileScan parquet [^\n]*{table}", plan)) <= scans
    assert not re.search(r"FileScan parquet [^\n]*documents\.parquet", plan)


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["rating_distribution"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["bug_category", "bug_count"] and df.count() > 5
