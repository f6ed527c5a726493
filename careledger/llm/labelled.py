"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_labels(labels: DataFrame, label_col: str, most: int, where=None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label (0 or 1) of about ``most`` rows at most, chosen by a hash of the id; rows without an id or label are left out."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    rows = rows if where is None else rows.filter(where)
    n = rows.count()
    share = int(min(1.0, most / max(n, 1)) * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share).dropDuplicates(["doc_id"])


def labelled_texts(docs: DataFrame, sampled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, text of the sampled rows. The sample is bounded, so it is broadcast and texts aren't shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(sampled), "doc_id")
