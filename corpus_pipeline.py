"""A corpus pipeline over ``documents``: toxicity, exact copies, near copies, mixing by source, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. A stage's result is
written to the shared folder and read again as the documents of the next one.

All stages take nulls in any column, empty and very long texts, repeated rows, rows that share an id, empty tables, and further columns of any
name, which they keep; the operators' docstrings say what comes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careledger.llm import exact, mixing, ngram_join, packing, toxicity
from careledger.llm.storage import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the ordinal model holds toxic; it is fitted on labels of this corpus. Without labels nothing goes."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text; null and empty texts are one text."""
    return exact.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies; rows without words stay."""
    return ngram_join.keep_one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources reach their target weights in words; a null source is a source."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences instead of documents; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Random choices, MinHash and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
