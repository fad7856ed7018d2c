"""Postings of documents: which words they have in which fields, and where.

Positions count the indexed tokens of a document over all its fields, in the order in
which they were added, so that a phrase can span two additions to one field that follow
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import MAX_TOKEN_BYTES, index_tokens, raw_tokens

TOKEN = "array<struct<field:string,word:string>>"
POSTINGS = "field string, word string, doc_id long, positions array<int>"
#: Catalyst repeats the token regex in a filter that it infers from explode; this keeps it from doing so.
NO_REPEAT = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def field_tokens(fields: dict[str, str | Column]) -> Column:
    """The tokens of a document in order, from the text columns of its fields."""

    def of(field: str, text: str | Column) -> Column:
        return F.transform(index_tokens(text), lambda t: F.struct(F.lit(field).alias("field"), t.alias("word")))

    parts = [of(f, t) for f, t in fields.items()]
    return F.concat(*parts) if parts else F.array().cast(TOKEN)


def entry_tokens(entries: DataFrame) -> DataFrame:
    """(doc_id, tokens) from rows (doc_id, seq, field, text), one for each addition, ordered by seq."""
    parts = entries.select("doc_id", F.struct("seq", F.transform(index_tokens("text"), lambda t: F.struct(F.col("field").alias("field"), t.alias("word"))).alias("tokens")).alias("part"))
    return parts.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["tokens"])).alias("tokens"))


def exploded(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, field, word) from (doc_id, tokens)."""
    return documents.select("doc_id", F.posexplode("tokens").alias("pos", "token")).select("doc_id", "pos", "token.field", "token.word")


def build(documents: DataFrame) -> DataFrame:
    """Postings from (doc_id, tokens), a row a document.

    The tokens of a document are sorted by word within their array and cut where the
    word changes, so that no shuffle is needed before the postings are clustered.
    """
    placed = F.sort_array(F.transform("tokens", lambda t, i: F.struct(t["word"].alias("word"), t["field"].alias("field"), i.alias("pos"))))
    rows = documents.select("doc_id", placed.alias("placed"))
    at = lambda i: F.get("placed", i)
    fresh = lambda i: (i == 0) | (at(i)["word"] != at(i - 1)["word"]) | (at(i)["field"] != at(i - 1)["field"])
    rows = rows.select("doc_id", "placed", F.filter(F.transform("placed", lambda _, i: i), fresh).alias("starts"))

    def posting(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get("starts", k + 1), F.size("placed")) - start
        positions = F.transform(F.slice("placed", start + 1, length), lambda x: x["pos"])
        return F.struct(at(start)["field"].alias("field"), at(start)["word"].alias("word"), positions.alias("positions"))

    found = rows.select("doc_id", F.explode(F.transform("starts", posting)).alias("p"))
    return found.select("p.field", "p.word", "doc_id", "p.positions")


#: Bytes of texts that are tokenised at once; one longer text is taken alone.
SLICE_BYTES = 2 << 20
#: Bytes of words that are grouped at once: the more, the fewer blocks.
GROUP_BYTES = 16 << 20


def slices(batch: pa.RecordBatch, first: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts, the columns from ``first`` on, have ``SLICE_BYTES`` in all."""
    sizes = [np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64) for c in batch.columns[first:]]
    total = np.cumsum(np.sum(sizes, axis=0)) if sizes else np.zeros(batch.num_rows)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        to = max(at + 1, min(to, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


#: While postings are ordered, a row holds up to BLOCK of a word, as bytes. No block has doc_ids of two spans of
#: 2^SPAN_BITS, so a word is ordered span by span, however many documents it has.
BLOCKS = "field string, word string, top long, n int, occurrences long, docs binary, counts binary, positions binary"
BLOCK = 128
SPAN_BITS = 16
#: Bytes of blocks, as they are stored, that one task orders.
TASK_BYTES = 32 << 20


def _bytes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The values from each start to the next, as bytes."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(key: np.ndarray, ids: np.ndarray, counts: np.ndarray, positions: np.ndarray, words) -> pa.RecordBatch:
    """Blocks of postings that are ordered by key, a number for field and word, and by falling doc_id; words(places) has the fields and words of some."""
    span = ids >> SPAN_BITS
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1])])
    group = np.flatnonzero(fresh)
    rank = np.arange(len(key)) - np.repeat(group, np.diff(np.append(group, len(key))))
    first = np.flatnonzero(rank % BLOCK == 0)
    at = np.append(0, np.cumsum(counts))[first]
    n, occurrences = np.diff(np.append(first, len(key))), np.diff(np.append(at, len(positions)))
    field, word = words(first)
    columns = [field, word, pa.array(ids[first]), pa.array(n.astype(np.int32)), pa.array(occurrences.astype(np.int64))]
    below = (np.repeat(ids[first], n) - ids).astype(np.uint16)  # of the block's largest, in one span
    columns += [_bytes(below, first), _bytes(counts.astype(np.int32), first), _bytes(positions.astype(np.int32), at)]
    return pa.RecordBatch.from_arrays(columns, names=["field", "word", "top", "n", "occurrences", "docs", "counts", "positions"])


class _Gathered:
    """Words of texts, until there are enough of them to be grouped."""

    def __init__(self, fields: list[str]):
        self.fields, self.ids, self.words, self.docs, self.kinds, self.places = fields, [], [], [], [], []
        self.rows = self.bytes = 0

    def add(self, part: pa.RecordBatch) -> None:
        n = part.num_rows
        before = np.zeros(n, np.int64)
        for f, column in enumerate(part.columns[1:]):
            found = [raw_tokens(t) if t else [] for t in column.to_pylist()]
            doc = np.repeat(np.arange(n), list(map(len, found)))
            word = pa.array([t for x in found for t in x], pa.binary())
            short = np.asarray(pc.binary_length(word)) <= MAX_TOKEN_BYTES
            if not short.all():
                doc, word = doc[short], word.filter(pa.array(short))
            count = np.bincount(doc, minlength=n)
            self.places.append((np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + before[doc]).astype(np.int32))
            before += count
            self.words.append(word)
            self.docs.append((doc + self.rows).astype(np.int32))
            self.kinds.append(np.full(len(doc), f, np.int16))
            self.bytes += word.nbytes
        self.ids.append(np.asarray(part.column(0)))
        self.rows += n

    def blocks(self) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays(self.words).dictionary_encode() if self.words else []
        if not len(coded):
            return
        ids, doc, kind, place = map(np.concatenate, (self.ids, self.docs, self.kinds, self.places))
        falling = np.argsort(-ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[falling] = np.arange(len(ids))
        size, n = len(coded.dictionary), len(ids)
        key = (kind * np.int64(size) + np.asarray(coded.indices)) * n + rank[doc]
        order = np.argsort(key, kind="stable")  # positions stay in order
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        said, doc = np.divmod(key[first], n)
        spelt = coded.dictionary.cast(pa.string())
        of = lambda at: (pa.array(self.fields, pa.string()).take(pa.array(said[at] // size)), spelt.take(pa.array(said[at] % size)))
        yield _packed(said, ids[falling][doc], np.diff(np.append(first, len(key))), place[order], of)


def _grouped(fields: list[str]):
    """Blocks of batches (doc_id, a text for each field), from ``GROUP_BYTES`` of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(fields)
        for batch in batches:
            for part in slices(batch):
                held.add(part)
                if held.bytes >= GROUP_BYTES:
                    yield from held.blocks()
                    held = _Gathered(fields)
        yield from held.blocks()

    return run


def text_blocks(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Blocks of postings from a row a document; ``fields`` maps fields to text columns. Texts
    are tokenised and their words grouped in Arrow batches, which is several times as fast as
    sorting arrays of tokens in expressions; nothing is moved."""
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields.values())])
    return texts.mapInArrow(_grouped(list(fields)), BLOCKS)


def blocks(postings: DataFrame) -> DataFrame:
    """Blocks of postings that are there as rows; the longer the runs of a word, the fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            field, word, ids = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode(), np.asarray(batch.column(2))
            key = np.asarray(field.indices).astype(np.int64) * len(word.dictionary) + np.asarray(word.indices)
            order = np.lexsort((-ids, key))
            rows = batch.take(pa.array(order))
            places = rows.column(3)
            yield _packed(key[order], ids[order], np.asarray(pc.list_value_length(places)), np.asarray(places.flatten()), lambda at, rows=rows: (rows.column(0).take(pa.array(at)), rows.column(1).take(pa.array(at))))

    return postings.select("field", "word", "doc_id", "positions").mapInArrow(run, BLOCKS)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """What the bytes of a column hold, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _unpacked(blocks: pa.RecordBatch, fresh: np.ndarray) -> pa.RecordBatch:
    """The postings of blocks, by falling doc_id from one fresh block to the next."""
    below, counts, positions = _numbers(blocks.column("docs"), np.uint16), _numbers(blocks.column("counts"), np.int32), _numbers(blocks.column("positions"), np.int32)
    n = np.asarray(pc.binary_length(blocks.column("docs"))) // 2
    ids = np.repeat(np.asarray(blocks.column("top")), n) - below
    block, group = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(fresh), n)
    if not np.all((group[1:] != group[:-1]) | (ids[1:] <= ids[:-1])):  # blocks of documents that lie between each other
        order = np.lexsort((-ids, group))
        starts = (np.cumsum(counts) - counts)[order]
        block, ids, counts = block[order], ids[order], counts[order]
        positions = positions[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(positions))]
    ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    at = pa.array(block)
    return pa.RecordBatch.from_arrays([blocks.column("field").take(at), blocks.column("word").take(at), pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(positions))], names=["field", "word", "doc_id", "positions"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """Postings from blocks. Blocks of a word and span that follow each other give postings by falling doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # blocks of the last word and span, of which more may come
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
            if not batch.num_rows:
                continue
            codes = [np.asarray(batch.column(c).dictionary_encode().indices) for c in ("field", "word")] + [np.asarray(batch.column("top")) >> SPAN_BITS]
            fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])
            last = int(np.flatnonzero(fresh)[-1])
            if last:
                yield _unpacked(batch.slice(0, last), fresh[:last])
            held = batch.slice(last)
        if held is not None:
            yield _unpacked(held, np.arange(held.num_rows) == 0)

    return blocks.select("field", "word", "top", "docs", "counts", "positions").mapInArrow(run, POSTINGS)


def of_texts(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Postings from a row a document, as rows."""
    return unpacked(text_blocks(rows, fields))


def tasks_for(stored: int, cores: int) -> int:
    """How many tasks order so many stored bytes of postings: it follows the input, so that a task's share doesn't grow and isn't spilled."""
    return max(1, -(-stored // TASK_BYTES), min(cores, stored // (1 << 20)))


def clustered(blocks: DataFrame, files: int) -> DataFrame:
    """Postings from blocks, by field, word and falling doc_id, from file to file: a file holds a range of words, and a word that fills more than a file is cut by doc_id."""
    span = F.shiftright("top", SPAN_BITS)
    ranged = blocks.repartitionByRange(files, F.col("field"), F.col("word"), span.desc())
    return unpacked(ranged.sortWithinPartitions("field", "word", F.desc("top")))


def block_stats(blocks: DataFrame) -> DataFrame:
    """(field, word, df, occurrences)."""
    return blocks.groupBy("field", "word").agg(F.sum(F.col("n").cast("long")).alias("df"), F.sum("occurrences").alias("occurrences"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, word, df, occurrences)."""
    return postings.groupBy("field", "word").agg(F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("occurrences"))


def entry_sizes(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.size("tokens").alias("n_tokens"))


def union(parts: list[DataFrame]) -> DataFrame:
    """The rows of one part after those of another; in halves, so that many parts give no deep plan."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return union(parts[:half]).unionByName(union(parts[half:]))
