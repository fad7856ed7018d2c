"""Sum-of-squares bin packing of documents into training sequences.

A document is as long as it has words. One longer than the capacity fills whole
sequences with its leading pieces, and its rest is packed like any other document.
The packer keeps, for every residual gap g, the number N(g) of open bins with that
gap. It puts each piece where the sum of N(g)^2 over all gaps becomes smallest: into
an open bin that has room, or into a new one. Ties go to the smaller gap, and to an
open bin before a new one; of the bins of one gap, to the one that got it last.

The packer is an online algorithm, so documents are spread by a hash of doc_id over
groups of about ``GROUP_DOCS`` documents, each packed by itself in order of doc_id:
work stays linear and parallel at any size, and only the last open bins of each
group are less than full. Lengths alone are shuffled, never texts.

Defined results: a row (doc_id, piece, start, length, bin_id, bin_start) for each
piece, in words; bin_id is unique over all groups. Null and word-less texts have one
row of length 0 without a bin. Rows of one doc_id, and equal rows, are packed
separately, shorter first; a null doc_id is a value like any other, and comes first.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

CAPACITY = 2048
GROUP_DOCS = 50_000


class Packer:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # N(g)
        self.bins: dict[int, list[int]] = {}  # gap -> bins, the last changed last
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin of a piece of 1 to capacity words, and where it starts there."""
        c, n = self.capacity, self.open
        best, gap = (2 * n[c - size] + 1 if size < c else 0), c
        if size < c:
            # change of the sum for a move from gap g to g - size, for g = size .. c - 1
            delta = n[: c - size] - n[size:c]
            delta *= 2
            delta += 2
            delta[0] = 1 - 2 * n[size]  # a full bin is no longer open
            delta[n[size:c] == 0] = np.iinfo(np.int64).max
            at = int(delta.argmin())
            if delta[at] <= best:
                gap = at + size
        if gap == c:
            home = self.made
            self.made += 1
        else:
            home = self.bins[gap].pop()
            n[gap] -= 1
        left = gap - size
        if left:
            n[left] += 1
            self.bins.setdefault(left, []).append(home)
        return home, c - gap


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            w = textvec.words(part.column("text"), hashed=False)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts().astype(np.int64))], names=["doc_id", "length"])


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("length", "ascending")])
        group = table.column("grp")[0].as_py()
        ids, lengths = table.column("doc_id").to_pylist(), table.column("length").to_pylist()
        if table.column("doc_id").null_count:  # Arrow sorts nulls last
            k = len(ids) - table.column("doc_id").null_count
            ids, lengths = ids[k:] + ids[:k], lengths[k:] + lengths[:k]
        packer = Packer(capacity)
        rows: list[tuple] = []
        for doc, length in zip(ids, lengths, strict=True):
            if not length:
                rows.append((doc, 0, 0, 0, None, None))
            for piece, start in enumerate(range(0, length, capacity)):
                size = min(capacity, length - start)
                home, at = packer.place(size)
                rows.append((doc, piece, start, size, (group << 32) | home, at))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "bin_id", "bin_start"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lengths = scratch.save(texts.mapInArrow(_lengths, "doc_id long, length long"), "pack-lengths")
    groups = max(1, -(-lengths.count() // group_docs))
    grouped = lengths.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long"))
    return grouped.groupBy("grp").applyInArrow(_pack(capacity), "doc_id long, piece int, start long, length long, bin_id long, bin_start long")
