"""Continuous ingest: micro-batches of documents or label operations become batches of an index.

Each micro-batch is committed once under its stream's name and number, so one that is
repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import Index


def stream_documents(index: Index, rows: DataFrame, fields: dict[str, str], checkpoint: str, stored: list[str] | None = None, name: str = "documents", **trigger) -> StreamingQuery:
    """Adds a streaming DataFrame of documents; see ``Index.add_documents``."""

    def add(batch: DataFrame, number: int) -> None:
        index.add_documents(batch, fields, stored, source=f"{name}/{number}")

    return _start(rows, add, checkpoint, trigger)


def stream_labels(index: Index, operations: DataFrame, checkpoint: str, name: str = "labels", **trigger) -> StreamingQuery:
    """Applies a streaming DataFrame (op, label, doc_id[, seq]); see ``Index.apply_labels`` for what counts within a micro-batch."""

    def apply(batch: DataFrame, number: int) -> None:
        index.apply_labels(batch, source=f"{name}/{number}")

    return _start(operations, apply, checkpoint, trigger)


def _start(rows: DataFrame, each, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
