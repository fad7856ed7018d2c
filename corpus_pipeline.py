"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage works on all that its predecessor kept, and all but the last return the
columns of ``documents``. What a stage gathers for itself comes from its own input;
labels and benchmark items are the tables beside the documents.

Defined results, for all stages: an empty table gives an empty one. Columns beyond
doc_id, text and n_chars are passed on, null or not, whatever their names. Texts are
worked on whole, however long. Rows of one doc_id, and equal rows, are decided on by their
own texts, and all stay or go together among near duplicates. Each stage states what it
does with null doc_ids, null and empty texts, and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import decontaminate, language_id, ngram_join, packing, quality, scratch
from sieveline.llm.queries import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents below the threshold of the learned quality ranking, and null and
    word-less texts; ties at the threshold stay. A null doc_id is no reason to go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are for the most part in no known language, and null and
    word-less texts. Ties go to the language that sorts first. Without labelled languages
    only scripts that stand for a language are known. A null doc_id is no reason to go."""
    return language_id.kept(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates, so there
    are no ties. Null and word-less texts and rows without doc_id have no duplicates and stay."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items out of the texts; a document that is cut whole goes.
    Null and empty texts stay as they are, and so do rows without doc_id."""
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in training sequences, a row a piece. Null and empty texts have a
    row without a sequence; a null doc_id is a value like any other; ties of bins go by the
    packer's rule."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_identification),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The learned stages can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
