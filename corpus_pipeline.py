"""From raw documents to packed sequences: quality, near copies, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read back
for the next one. All but the last return the columns of ``documents``.

Every stage takes null and empty texts (quality drops them: they have too few words), very long texts,
rows that repeat an id or all of another row, null ids, and tables without rows; extra columns of any
name are kept but for those beginning with an underscore, and for ``kept_text``, ``trimmed_text``,
``n_words`` and ``n_removed``, which the substring stage uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import mixing, near_duplicates, packing, quality, substrings
from ticketloom.llm.queries import TOKENIZER
from ticketloom.session import materialise

# SQL has no word for the trained and iterative stages; the tests hold the rows against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules hold for good; the rest goes."""
    known = quality.fit(quality.measures(docs, "text", []))
    return quality.keep_good(docs, "text", known)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document of the least id.

    Rows are numbered once and stored, so that rows which share an id stay apart, and of rows that are
    equal in all one stays.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates.classes(numbered, key="_row").withColumnRenamed("class_id", "_class")
    first = numbered.select("_row", "doc_id").join(classes, "_row").groupBy("_class").agg(
        F.min(F.struct("doc_id", "_row")).alias("_first")
    )
    return numbered.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds, line breaks kept; a text of nothing else goes."""
    made = substrings.dedup(docs, trimmed=True).filter("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    changed = {
        "text": F.when(cut, F.col("trimmed_text")).otherwise(F.col("text")),
        "n_chars": F.when(cut, F.char_length("trimmed_text").cast("long")).otherwise(F.col("n_chars")),
    }
    return made.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that give every source, language and topic its target share."""
    mixed = mixing.mix(docs, mixing.default_margins(), share=mixing.SHARE, tokenizer=TOKENIZER)
    return mixed.filter("_sampled").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, "doc_id", "text", TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each stored and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
