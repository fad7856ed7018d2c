"""Documents from files.

``text_files`` makes one document of each file. ``mbox`` makes one of each mail of
mailbox files: a mail begins at a line that starts with ``From ``, that line is left
out, and all others are its body, in ASCII lower case. Mailboxes are split by that line
as record separator, so large ones are read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import ascii_lower, raw_tokens
from ..operators.index import Index
from ..operators.postings import slices

INBOX = "inbox"


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, body), one row a file, in order of the paths."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.orderBy("path")


def mbox(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, offset, body), one row a mail; offset is its place among the records of its task, for order only."""
    records = spark.read.option("lineSep", "\nFrom ").text(paths).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("offset"), "value")
    mails = records.filter(F.length("value") > 0)
    # the separator took the line's first word, but at the start of a file
    body = F.regexp_replace("value", r"^[^\n]*\n?", "")
    return mails.select("path", "offset", ascii_lower(body).alias("body"))


def index_text_files(index: Index, paths: str | list[str]) -> int:
    return index.add_documents(text_files(index.spark, paths), {"body": "body"}, ["path", "body"])


def index_mbox(index: Index, paths: str | list[str]) -> int:
    """Adds the mails, with the place of each as ``path`` and ``offset``, and labels them ``inbox``."""
    done = index._add_rows(mbox(index.spark, paths), {"body": "body"}, ["path", "offset", "body"], None, None)
    if not done or not done["docs"]:
        return 0
    added = index._table("docs", "doc_id long", [done])
    index.add_labels(added.select(F.lit(INBOX).alias("label"), "doc_id"))
    return done["docs"]


def random_queries(documents: DataFrame, column: str = "body", share: float = 0.0001, words: int = 5, seed: int = 0) -> DataFrame:
    """(query): strings of words sampled from the documents, up to ``words`` each, to measure with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, held = np.random.default_rng([seed, TaskContext.get().partitionId()]), []
        for batch in batches:
            for part in slices(batch, 0):
                found = [t for x in part.column(0).to_pylist() if x for t in raw_tokens(x)]
                held += found if share >= 1 else [found[i] for i in np.flatnonzero(rng.random(len(found)) < share)]
                whole = len(held) - len(held) % words
                if whole:
                    yield lines(held[:whole])
                    held = held[whole:]
        if held:
            yield lines(held)

    def lines(picked: list[bytes]) -> pa.RecordBatch:
        joined = picked if words == 1 else [b" ".join(picked[i : i + words]) for i in range(0, len(picked), words)]
        return pa.RecordBatch.from_arrays([pa.array(joined, pa.binary()).cast(pa.string())], names=["query"])

    # words of a line follow each other in a task, so nothing is moved
    return documents.select(F.col(column).cast("string")).mapInArrow(run, "query string")
