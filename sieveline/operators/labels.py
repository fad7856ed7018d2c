"""Labels as a log of additions and removals; the last operation on a label and document counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "seq long, op string, label string, doc_id long"
#: What a batch of the log holds; seq is the number of its commit.
STORED = "op string, label string, doc_id long"
ADD, REMOVE = "add", "remove"


def current(log: DataFrame) -> DataFrame:
    """(label, doc_id) of the labels that documents carry now."""
    last = log.groupBy("label", "doc_id").agg(F.max_by("op", "seq").alias("op"))
    return last.filter(F.col("op") == ADD).select("label", "doc_id")


def changes(have: DataFrame, want: DataFrame) -> DataFrame:
    """(op, label, doc_id) that turn the labels in have into those in want; both (label, doc_id)."""
    both = ["label", "doc_id"]
    added = want.select(both).distinct().join(have, both, "left_anti").select(F.lit(ADD).alias("op"), *both)
    removed = have.select(both).join(want, both, "left_anti").select(F.lit(REMOVE).alias("op"), *both)
    return added.unionAll(removed)


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("df"))
