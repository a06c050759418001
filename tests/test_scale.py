"""What grows with the tables is done once, and by as many tasks as there is work for."""

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks import views as T
from ticketloom.operators import models
from ticketloom.session import materialise
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["other_split", "category_insights", "kpis"])
def test_keywords_are_looked_for_once(spark, name):
    """The result reads the stored categories; before, its plan held the keyword pattern several times."""
    assert "regexp_extract_all" not in plan(queries.REGISTRY[name](spark, SMALL))


def test_sent_tickets_of_a_stored_board(spark):
    board = materialise(T.ticket_view(spark, SMALL), "board")
    given, made = T.sent(spark, SMALL, board), T.sent(spark, SMALL)
    assert given.count() == made.count() and given.exceptAll(made).isEmpty()


def test_rows_take_the_cluster_of_their_vector(spark):
    """No row is compared with the centres: near one of them that goes through all places of a vector."""
    texts = spark.range(300).select("id", F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("t"))
    made = models.cluster_other(models.text_features(texts, "t"), k=3)
    assert "KMeans" not in plan(made) and made.columns[-1] == "cluster"
    assert not [e for e in plan(made).splitlines() if "AS cluster" in e and "UDF" in e]
    by_text = made.groupBy("t").agg(F.count_distinct("cluster").alias("n"), F.count("*").alias("rows")).collect()
    assert [(r.n, r.rows) for r in by_text] == [(1, 100)] * 3


def test_more_text_makes_more_csv_files(spark, monkeypatch):
    few = queries.csv_blocks(spark, SMALL)
    monkeypatch.setattr(queries, "CSV_FILE_BYTES", 1)
    written = []
    write = queries.writers.write_csv
    monkeypatch.setattr(queries.writers, "write_csv", lambda df, path: (written.append(df.rdd.getNumPartitions()), write(df, path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        many = queries.csv_blocks(spark, SMALL)
        assert written[0] > 2 and many.count() == few.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
