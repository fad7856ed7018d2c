"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items make one automaton that accepts every
run of words of any item. Streaming a text's words through it gives, at each word,
the length of the longest run ending there that some item contains. A run is cut
from the text when it has at least ``LENGTH`` words, or covers at least ``COVERAGE``
of an item that contains it (and has ``LEAST`` words).

A run to cut contains a window of ``LEAST`` words (or of the shortest length that
can be cut) that an item contains. Windows are looked up by hash for all words of a
batch at once, and only the stretches of consecutive hits are streamed: outside them
no run is long enough. On the way, windows of 1, 2, ... words are looked up where the
two windows within them were found, which gives the longest match of all other texts.

An automaton holds at most ``TOKENS`` words of items. A larger benchmark makes several:
each is built, broadcast and dropped in turn, and marks the texts in a pass of its own,
whose marks are kept in the shared folder; the last pass cuts. So memory and what is
broadcast at once don't grow with the benchmark, and the result is that of one automaton.

Defined results. All rows and columns come back; ``text`` has lost the cut runs with
the punctuation after them, ``n_chars``, if there is one, follows it, and
``removed_words`` and ``longest_match`` are added (columns of these names are
replaced). Null texts stay null; texts without a cut stay byte for byte; a text
that is cut whole becomes empty. Items that are null or have fewer than ``LEAST``
words are ignored; repeated items count once. Repeated rows are treated alike. Very long
texts are streamed whole. Without items nothing is cut; an empty table gives no rows.
``kept`` gives the rows with their own columns only, without those that are cut whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, textvec

LENGTH = 10
COVERAGE = 0.6
LEAST = 5
#: Words of benchmark items in one automaton.
TOKENS = 100_000

_TAIL = b".,;:!?)]}\"'"


class Automaton:
    """Generalised suffix automaton over word ids; state 0 is the root."""

    def __init__(self, items: list[list[int]], length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST):
        items = [list(x) for x in dict.fromkeys(map(tuple, items)) if len(x) >= least]
        self.length, self.coverage, self.least = length, coverage, least
        self.go: list[dict[int, int]] = [{}]
        self.link, self.depth = [-1], [0]
        self.shortest = [math.inf]  # length of the shortest item that contains the state's runs
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
                self.shortest[last] = min(self.shortest[last], len(item))
        by_depth = sorted(range(1, len(self.go)), key=self.depth.__getitem__)
        for v in reversed(by_depth):
            u = self.link[v]
            self.shortest[u] = min(self.shortest[u], self.shortest[v])
        # the longest proper suffix of the state's runs that is to be cut by itself
        self.suffix = [0] * len(self.go)
        for v in by_depth:
            u = self.link[v]
            self.suffix[v] = self.depth[u] if u and self.cuts(u, self.depth[u]) else self.suffix[u]
        #: Every run that is cut has at least so many words.
        self.window = max(1, min([length, *(max(least, math.ceil(coverage * len(x) - 1e-9)) for x in items)]))
        #: The runs of 1, 2, ... words of the items, up to such windows.
        self.windows = [sorted({tuple(x[i : i + n]) for x in items for i in range(len(x) - n + 1)}) for n in range(1, self.window + 1)]

    def _extend(self, last: int, word: int) -> int:
        go, link, depth = self.go, self.link, self.depth
        if word in go[last]:
            v = go[last][word]
            return v if depth[v] == depth[last] + 1 else self._split(last, word, v)
        new = self._state(depth[last] + 1, {})
        p = last
        while p >= 0 and word not in go[p]:
            go[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            v = go[p][word]
            link[new] = v if depth[v] == depth[p] + 1 else self._split(p, word, v)
        return new

    def _split(self, p: int, word: int, v: int) -> int:
        go, link = self.go, self.link
        copy = self._state(self.depth[p] + 1, dict(go[v]))
        link[copy], link[v] = link[v], copy
        while p >= 0 and go[p].get(word) == v:
            go[p][word] = copy
            p = link[p]
        return copy

    def _state(self, depth: int, go: dict[int, int]) -> int:
        self.go.append(go)
        self.link.append(0)
        self.depth.append(depth)
        self.shortest.append(math.inf)
        return len(self.go) - 1

    def cuts(self, state: int, run: int) -> bool:
        return run >= self.length or run >= self.least and run >= self.coverage * self.shortest[state] - 1e-9

    def stream(self, tokens: list[int]) -> tuple[list[tuple[int, int]], int]:
        """Runs (start, end) to cut, in order of end, and the longest match."""
        state = run = longest = 0
        found = []
        for at, word in enumerate(tokens):
            while state and word not in self.go[state]:
                state = self.link[state]
                run = self.depth[state]
            if word in self.go[state]:
                state = self.go[state][word]
                run += 1
            else:
                state = run = 0
            longest = max(longest, run)
            cut = run if run and self.cuts(state, run) else self.suffix[state] if state else 0
            if cut:
                found.append((at + 1 - cut, at + 1))
        return found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the byte spans, the punctuation right after each, and one of two blanks that then meet."""
    parts, at = [], 0
    for a, b in spans:
        while b < len(raw) and raw[b] in _TAIL:
            b += 1
        if a and raw[a - 1 : a] == b" " and (b == len(raw) or raw[b : b + 1] in (b" ", b"\n")):
            a -= 1
        parts.append(raw[at : max(at, a)])
        at = max(at, b)
    parts.append(raw[at:])
    return b"".join(parts)


class _Finder:
    """An automaton with its vocabulary and windows as sorted hashes."""

    def __init__(self, vocabulary: np.ndarray, automaton: Automaton):
        self.vocabulary, self.automaton = vocabulary, automaton
        self.windows, self.bits = [], []
        for n, runs in enumerate(automaton.windows, 1):
            rows = np.array(runs, np.int64).reshape(-1, n)
            h = np.zeros(len(rows), np.uint64)
            for j in range(n):
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + vocabulary[rows[:, j]]
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.windows.append(np.unique(h))
            self.bits.append(bits)
        automaton.windows = []  # not to be broadcast twice

    def find(self, w: textvec.Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
        """By text: the runs of words to cut, as indices into w, and the longest match."""
        n, m = self.automaton.window, len(w.hash)
        spans: dict[int, list[tuple[int, int]]] = {}
        longest: dict[int, int] = {}
        hit, h = np.arange(m), w.hash
        for k, (windows, bits) in enumerate(zip(self.windows, self.bits, strict=True), 1):
            if k > 1:
                # the windows of k - 1 words from here and from the next word on were found
                both = np.flatnonzero(np.diff(hit) == 1)
                both = both[w.doc[hit[both]] == w.doc[hit[both] + k - 1]]
                hit, h = hit[both], h[both] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[hit[both] + k - 1]
            may = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            hit, h = hit[may], h[may]
            at = np.searchsorted(windows, h)
            at[at == len(windows)] = 0
            found = windows[at] == h if len(windows) else np.zeros(0, bool)
            hit, h = hit[found], h[found]
            if not len(hit):
                return spans, longest
            longest.update(dict.fromkeys(np.unique(w.doc[hit]).tolist(), k))
        breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(w.doc[hit]) > 0)) + 1
        for stretch in np.split(hit, breaks):
            a, b = int(stretch[0]), int(stretch[-1]) + n
            ids = np.searchsorted(self.vocabulary, w.hash[a:b])
            found, best = self.automaton.stream(ids.tolist())
            doc = int(w.doc[a])
            longest[doc] = max(longest.get(doc, 0), best)
            if found:
                spans.setdefault(doc, []).extend((a + x, a + y) for x, y in found)
        return spans, longest


def _finders(benchmark: DataFrame, length: int, coverage: float, least: int, tokens: int) -> Iterator[_Finder]:
    """One finder for each chunk of items; the driver holds one chunk at a time."""

    def build(hashes: list[np.ndarray]) -> _Finder:
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        return _Finder(vocabulary, Automaton([np.searchsorted(vocabulary, x).tolist() for x in hashes], length, coverage, least))

    held: list[np.ndarray] = []
    size = 0
    for row in benchmark.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct().orderBy("text").toLocalIterator():
        h = textvec.words(pa.array([row.text])).hash
        if len(h) < least:
            continue
        if held and size + len(h) > tokens:
            yield build(held)
            held, size = [], 0
        held.append(h)
        size += len(h)
    yield build(held)


def _pass(finder, text_at: int, chars_at: int | None, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, batch.schema.names[text_at]):
                columns = part.columns
                k = len(columns) - 2  # before it: the documents' columns; then marks and the longest match
                w = textvec.words(columns[text_at])
                found, best = finder.value.find(w)
                longest = np.maximum(np.asarray(columns[k + 1]), [best.get(i, 0) for i in range(part.num_rows)])
                marks = columns[k].to_pylist()
                for i, spans in found.items():
                    marks[i] = (marks[i] or []) + [int(x - w.first[i]) for s in merged(spans) for x in s]
                removed = np.zeros(part.num_rows, np.int32)
                if last:
                    texts = None
                    for i, flat in enumerate(marks):
                        if not flat:
                            continue
                        if texts is None:
                            texts = columns[text_at].to_pylist()
                        spans = merged(list(zip(flat[::2], flat[1::2], strict=True)))
                        base, first = int(w.text_off[i]), int(w.first[i])
                        in_bytes = [(int(w.start[first + a]) - base, int(w.end[first + b - 1]) - base) for a, b in spans]
                        texts[i] = cut(texts[i].encode(), in_bytes).decode()
                        removed[i] = sum(b - a for a, b in spans)
                    if texts is not None:
                        columns[text_at] = pa.array(texts, columns[text_at].type)
                        if chars_at is not None:
                            chars = columns[chars_at].to_pylist()
                            for i in np.flatnonzero(removed):
                                chars[i] = len(texts[i])
                            columns[chars_at] = pa.array(chars, columns[chars_at].type)
                    columns[k] = pa.array(removed)
                else:
                    columns[k] = pa.array(marks, pa.list_(pa.int32()))
                columns[k + 1] = pa.array(longest.astype(np.int32))
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST, tokens: int = TOKENS) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    kept = [i for i, c in enumerate(docs.columns) if c not in ("removed_words", "longest_match")]
    names = [docs.columns[i] for i in kept]
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names and isinstance(docs.schema.fields[kept[names.index("n_chars")]].dataType, (T.LongType, T.IntegerType)) else None
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in kept])
    inner = inner.withColumn(inner.columns[text_at], F.col(inner.columns[text_at]).cast("string"))
    now = inner.select("*", F.lit(None).cast("array<int>").alias("removed_words"), F.lit(0).alias("longest_match"))
    base = list(inner.schema.fields)
    finders = _finders(benchmark, length, coverage, least, tokens)
    finder = next(finders)
    while True:
        after = next(finders, None)
        shared = sc.broadcast(finder)
        mark = T.IntegerType() if after is None else T.ArrayType(T.IntegerType())
        now = now.mapInArrow(_pass(shared, text_at, chars_at, after is None), T.StructType([*base, T.StructField("removed_words", mark), T.StructField("longest_match", T.IntegerType())]))
        if after is None:
            return now.toDF(*names, "removed_words", "longest_match")
        now = scratch.save(now, "decontaminate-marks")
        shared.destroy()
        finder = after


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, cut, with the columns of docs; a text of which nothing but blanks is left goes."""
    places = [c if c in ("text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)]
    clean = decontaminate(docs.toDF(*places), benchmark)
    return clean.filter("removed_words = 0 or trim(text) <> ''").select(*places).toDF(*docs.columns)
