"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on one Arrow string array at a time: the UTF-8 bytes of all its
texts are one numpy buffer, and words, their hashes and their n-grams come from a
fixed number of array operations, without a Python step per word.

Words. A text is folded (each character whose lower-case form has the same UTF-8
length is lower-cased, which keeps byte offsets) and cut at separators: the ASCII
characters that are neither letters nor digits, U+00A0..U+00BF, U+00D7, U+00F7,
U+2000..U+207F and U+3000..U+303F. A word is a maximal run of anything else.

Hashes are 64-bit polynomial hashes with a final mix; equality of words and
n-grams is equality of their hashes throughout.

A null text has no words, like an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are taken in slices of about so many bytes, which bounds memory; one
#: longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: The same for what holds a hundred bytes and more for each byte of text, and is kept beside a grown heap.
FINE_BYTES = 1 << 19

#: The same word pattern for SQL engines, to be applied to lower-cased text.
WORD_SQL = r"[^\x00-/:-@\[-`{-\x7f\x{a0}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{207f}\x{3000}-\x{303f}]+"

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = n + (n >> 2)
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            np.multiply.accumulate(steps, out=steps)
            if size > 8 * SLICE_BYTES:
                return tuple(_long_pow(size))  # a giant text: not kept
            _powers[k] = steps
    return _powers[0], _powers[1]


def _long_pow(size: int) -> Iterator[np.ndarray]:
    for base in (_P, _PINV):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        yield np.multiply.accumulate(steps, out=steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _fold_char(c: str) -> str:
    low = c.lower()
    return low if len(low.encode()) == len(c.encode()) else c


def _buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array without nulls."""
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def fold(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes (a copy) and the offsets of each text in them; nulls are empty."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, off = _buffer(arr)
    low, low_off = _buffer(pc.utf8_lower(arr))
    if not np.array_equal(off, low_off):
        texts = arr.to_pylist()
        odd = np.flatnonzero(np.diff(off) != np.diff(low_off))
        lowered = pc.utf8_lower(arr).to_pylist()
        for i in odd:
            lowered[i] = "".join(map(_fold_char, texts[i]))
        low, low_off = _buffer(pa.array(lowered, pa.large_string()))
    buf = low.copy()
    if len(buf) > 1 and (buf >= 0xC2).any():
        a, b = buf[:-1], buf[1:]
        two = np.flatnonzero(((a == 0xC2) & (b >= 0xA0)) | ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))))
        three = np.flatnonzero(((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
        for at in (two, two + 1, three, three + 1, three + 2):
            buf[at] = 32
    return buf, low_off


@dataclass
class Words:
    """The words of a slice of texts, in order: byte spans into ``buf`` and hashes."""

    buf: np.ndarray
    text_off: np.ndarray  # byte offset of each text, and the end
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the text of each word
    first: np.ndarray  # index of the first word of each text, and the count
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(arr: pa.Array, hashed: bool = True) -> Words:
    buf, off = fold(arr)
    n = len(off) - 1
    isw = _WORD[buf]
    edge = np.flatnonzero(isw[1:] != isw[:-1]) + 1 if len(isw) else np.zeros(0, np.int64)
    # texts border on each other without a separator
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    both = cut[isw[cut] & isw[cut - 1]] if len(cut) else cut
    start = edge[isw[edge]]
    end = edge[~isw[edge]]
    if len(isw) and isw[0]:
        start = np.concatenate([[0], start])
    if len(isw) and isw[-1]:
        end = np.concatenate([end, [len(buf)]])
    if len(both):
        both = np.unique(both)
        start = np.sort(np.concatenate([start, both]))
        end = np.sort(np.concatenate([end, both]))
    start, end = start.astype(np.int64), end.astype(np.int64)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    h = np.zeros(0, np.uint64)
    if hashed and len(start):
        pw, ipw = _pow(len(buf) + 1)
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        prod = buf.astype(np.uint64)
        prod += np.uint64(1)
        prod *= pw[: len(buf)]
        np.cumsum(prod, out=sums[1:])
        h = mix((sums[end] - sums[start]) * ipw[start])
    return Words(buf, off, start, end, doc, first, h)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of n words. A text of 1 to n-1 words has one
    gram, of all its words; a text without words has none."""
    m = len(w.hash)
    size = w.counts()
    if m >= n:
        h = w.hash[: m - n + 1].copy()
        for j in range(1, n):
            h *= _Q
            h += w.hash[j : m - n + 1 + j]
        doc = w.doc[: m - n + 1]
        ok = doc == w.doc[n - 1 :]
        h, doc = mix(h[ok] + np.uint64(n)), doc[ok]
    else:
        h, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = []
        for i in short:
            x = 0
            for v in w.hash[w.first[i] : w.first[i + 1]].tolist():
                x = (x * int(_Q) + v) & 0xFFFFFFFFFFFFFFFF
            extra.append((x + int(size[i])) & 0xFFFFFFFFFFFFFFFF)
        h = np.concatenate([h, mix(np.array(extra, np.uint64))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column``, at least a row each."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = int(np.searchsorted(total, base + limit, side="right"))
        to = max(at + 1, min(to, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


def keep_rows(docs: DataFrame, wanted: Callable[[pa.Array], np.ndarray], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs whose text is wanted, with all their columns, in one pass over slices of limit bytes."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    inner = docs.toDF(*places)
    inner = inner.withColumn(places[at], F.col(places[at]).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, places[at], limit):
                yield part.filter(pa.array(wanted(part.column(at)), pa.bool_()))

    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)
