"""Token ids of documents in sorted-string-table shards.

Texts are tokenised with a public byte-level vocabulary and written as immutable
shards, ordered by document identifier over all shards. A shard file holds

    blocks   entries in key order; a key is the identifier as 8 bytes that sort like
             it, and each entry has the length of the prefix that it shares with the
             key before, the rest of the key, and the value
    index    the first key, offset, length, entries and checksum of each block
    Bloom    BLOOM_BITS bits a key, with BLOOM_HASHES probes
    footer   of fixed size: magic, where index and filter are, and totals

A lookup finds the shard by binary search over the shards' first keys, asks its Bloom
filter, finds the block by binary search in its sparse index and reads that block only.
A value is one zstd frame of the token ids, 2 bytes each (4 for vocabularies of more
than 65,536 ids).

A shard has about ``SHARD_BYTES`` of text; a smaller input makes as many as the
session has cores, of ``LEAST_BYTES`` or more. A task streams one shard to a file of a
name of its own, and the table of shards lists only those of attempts that Spark
committed, so lost and repeated attempts leave no trace in it.

Defined results. Rows without doc_id have no key and aren't stored. Rows of one
doc_id, and equal rows, are stored each, in order of their text, and a lookup returns
all. A null text is stored as null, an empty one as no ids. Special tokens' names in
texts are ordinary text. Very long texts are stored whole; a run of more than ``BLANKS``
blank characters is tokenised in parts of that length, as the pattern can't match longer
ones, and reads back as it was. Other columns are ignored, whatever their names. An
empty table makes no shards.
"""

from __future__ import annotations

import base64
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, scratch, textvec

#: A vocabulary file of ranks, and the pattern that cuts texts before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES = 512 << 20
LEAST_BYTES = 16 << 20
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
#: Blank characters in a row that are tokenised at once.
BLANKS = 1 << 16

_MAGIC = b"SLVSST01"
_FOOTER = struct.Struct("<8sQQQQQQQI4x")  # magic; index, filter: offset, length; blocks; entries; tokens; bytes an id
_BLOCK = np.dtype([("key", ">u8"), ("offset", "<u8"), ("length", "<u4"), ("entries", "<u4"), ("check", "<u4")])
SCHEMA = "shard int, path string, first_id long, last_id long, entries long, tokens long, bytes long"


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """(keys, BLOOM_HASHES) bit numbers."""
    a = textvec.mix(keys)
    b = textvec.mix(a ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes one shard; entries come in key order."""

    def __init__(self, out: pa.NativeFile, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.block, self.in_block, self.block_key = bytearray(), 0, b""
        self.last = b""
        self.index: list[tuple] = []
        self.keys: list[int] = []
        self.at = self.entries = self.tokens = 0

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if key < self.last:
            raise ValueError("keys must come in order")
        if len(self.block) >= self.block_bytes:
            self._flush()
        shared = 0
        if self.in_block:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_key = key
        self.block += bytes((shared, 8 - shared)) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.entries += 1
        self.tokens += tokens
        if key != self.last:
            self.keys.append(struct.unpack(">Q", key)[0])
        self.last = key

    def _flush(self) -> None:
        if self.in_block:
            self.index.append((struct.unpack(">Q", self.block_key)[0], self.at, len(self.block), self.in_block, zlib.crc32(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> int:
        """Bytes of the file."""
        self._flush()
        index = np.array(self.index, _BLOCK).tobytes()
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        field = np.zeros(bits, np.uint8)
        field[_probes(np.array(self.keys, np.uint64), bits).ravel().astype(np.int64)] = 1
        bloom = np.packbits(field).tobytes()
        footer = _FOOTER.pack(_MAGIC, self.at, len(index), self.at + len(index), len(bloom), len(self.index), self.entries, self.tokens, self.id_bytes)
        self.out.write(index + bloom + footer)
        self.out.close()
        return self.at + len(index) + len(bloom) + len(footer)


class Shard:
    """Reads one shard."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        footer = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if footer[0] != _MAGIC:
            raise ValueError("not a shard")
        _, at, length, bloom_at, bloom_length, blocks, self.entries, self.tokens, self.id_bytes = footer
        self.index = np.frombuffer(file.read_at(length, at), _BLOCK)
        if len(self.index) != blocks:
            raise ValueError("the index is damaged")
        self.first = self.index["key"].astype(np.uint64)
        self.bloom = np.frombuffer(file.read_at(bloom_length, bloom_at), np.uint8)
        self.unzip = zstandard.ZstdDecompressor()
        self.held: tuple[int, list[tuple[bytes, bytes]]] = (-1, [])  # the block that was read last

    def may_have(self, doc_id: int) -> bool:
        bits = _probes(np.array([doc_id + (1 << 63)], np.uint64), len(self.bloom) * 8)[0]
        return bool(((self.bloom[(bits >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bits & np.uint64(7)).astype(np.uint8))) & 1).all())

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        row = self.index[i]
        raw = self.file.read_at(int(row["length"]), int(row["offset"]))
        if zlib.crc32(raw) != row["check"]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < len(raw):
            shared, rest = raw[at], raw[at + 1]
            at += 2
            length = shift = 0
            while True:
                byte = raw[at]
                at += 1
                length |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + length]
            at += length

    def ids(self, value: bytes) -> np.ndarray | None:
        if not value:
            return None
        return np.frombuffer(self.unzip.decompress(value), np.uint16 if self.id_bytes == 2 else np.uint32)

    def get(self, doc_id: int) -> list[np.ndarray | None]:
        """The token ids of each row of the document."""
        if not len(self.index) or not self.may_have(doc_id):
            return []
        key, found = key_of(doc_id), []
        # rows of one document may begin in the block before the first that starts with its key
        i = max(0, int(np.searchsorted(self.first, np.uint64(doc_id + (1 << 63)), side="left")) - 1)
        while i < len(self.index) and self.first[i] <= np.uint64(doc_id + (1 << 63)):
            if self.held[0] != i:
                self.held = i, list(self.block(i))
            found += [self.ids(v) for k, v in self.held[1] if k == key]
            i += 1
        return found

    def scan(self) -> Iterator[tuple[int, np.ndarray | None]]:
        for i in range(len(self.index)):
            for key, value in self.block(i):
                yield id_of(key), self.ids(value)


def tokenizer(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={}), max(table.values(), default=0) + 1


_RUN = re.compile(r"\s+")


def encode(encoding, text: str) -> list[int]:
    """The token ids of a text."""
    if len(text) <= BLANKS:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _RUN.finditer(text):
        if m.end() - m.start() > BLANKS:
            for to in range(m.start() + BLANKS, m.end(), BLANKS):
                ids += encoding.encode_ordinary(text[at:to])
                at = to
    return ids + encoding.encode_ordinary(text[at:])


def _write(folder: str, ranks, pattern: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding, size = tokenizer(ranks.value, pattern)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        squeeze = zstandard.ZstdCompressor(level=1)
        writer = path = first = None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.sst"
                    writer, first = Writer(files.create(path), np.dtype(kind).itemsize, block_bytes), doc_id
                ids = None if text is None else encode(encoding, text)
                value = b"" if ids is None else squeeze.compress(np.array(ids, kind).tobytes())
                writer.add(key_of(doc_id), value, len(ids or ()))
                last = doc_id
        if writer is not None:
            size = writer.close()
            row = [TaskContext.get().partitionId(), path, first, last, writer.entries, writer.tokens, size]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "path", "first_id", "last_id", "entries", "tokens", "bytes"])

    return run


def _rows(doc_id: list[int], ids: list[np.ndarray | None]) -> pa.RecordBatch:
    off = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in ids], out=off[1:])
    flat = np.concatenate([x for x in ids if x is not None]).astype(np.int32) if off[-1] else np.zeros(0, np.int32)
    nulls = pa.array([x is None for x in ids], pa.bool_())
    lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=nulls)
    counts = pa.array([None if x is None else len(x) for x in ids], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), counts, lists], names=["doc_id", "n_tokens", "tokens"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            held, values, size = [], [], 0
            for doc_id, ids in Shard(files.read_at(path)).scan():
                held.append(doc_id)
                values.append(ids)
                size += 64 + (0 if ids is None else len(ids))
                if size > 1 << 20:
                    yield _rows(held, values)
                    held, values, size = [], [], 0
            if held:
                yield _rows(held, values)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (path, doc_id), sorted: the rows of the documents."""
    shard, at = None, None
    for batch in batches:
        held, values, size = [], [], 0
        for path, doc_id in zip(batch.column("path").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            if path != at:
                shard, at = Shard(files.read_at(path)), path
            for ids in shard.get(doc_id):
                held.append(doc_id)
                values.append(ids)
                size += 64 + (0 if ids is None else len(ids))
            if size > 1 << 20:
                yield _rows(held, values)
                held, values, size = [], [], 0
        if held:
            yield _rows(held, values)


ROWS = "doc_id long, n_tokens int, tokens array<int>"


@dataclass
class Store:
    """Shards in the shared folder; ``shards`` is the table of them, one row each."""

    shards: DataFrame

    def scan(self) -> DataFrame:
        """All documents: (doc_id, n_tokens, tokens)."""
        n = max(1, self.shards.count())
        return self.shards.select("path", "shard").repartitionById(n, "shard").select("path").mapInArrow(_scan, ROWS)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The documents with the doc_ids of ids, by binary search; unknown ids give no row."""
        ranges = self.shards.select("path", "first_id", "last_id")
        wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        # the first ids of the shards, 8 bytes for each SHARD_BYTES of text
        spots = sorted((r.first_id, r.last_id, r.path) for r in ranges.collect())
        if not spots:
            return ids.sparkSession.createDataFrame([], ROWS)
        shared = ids.sparkSession.sparkContext.broadcast((np.array([s[0] for s in spots]), np.array([s[1] for s in spots]), [s[2] for s in spots]))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, last, paths = shared.value
            for batch in batches:
                want = np.asarray(batch.column("doc_id"))
                at = np.searchsorted(first, want, side="right") - 1
                on = (at >= 0) & (want <= last[at])
                yield pa.RecordBatch.from_arrays([pa.array(want[on]), pa.array([paths[i] for i in at[on]], pa.string())], names=["doc_id", "path"])

        placed = wanted.mapInArrow(place, "doc_id long, path string").repartition(min(len(spots), 4096), "path")
        return placed.sortWithinPartitions("path", "doc_id").select("path", "doc_id").mapInArrow(_find, ROWS)


def write(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, least_bytes: int = LEAST_BYTES) -> Store:
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # of the vocabulary's size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0].b
    shards = max(1, math.ceil(total / shard_bytes), min(2 * spark.sparkContext.defaultParallelism, total // least_bytes))
    folder = scratch.new_path(spark, "sstable")
    # equal ids meet in one partition, so shards don't overlap
    ordered = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return Store(scratch.save(ordered.mapInArrow(_write(folder, ranks, pattern, block_bytes), SCHEMA), "sstable-shards"))
