"""HTML text extraction that drops what pages of a host repeat.

The visible text of each page becomes a stream of words, and the streams of a host's
pages are concatenated. Their suffixes are ranked by doubling: ranks by the first word,
then by two, four and so on up to ``MIN_RUN`` words, each from the ranks before. That is
the suffix array to the depth of the shortest run that counts: suffixes of equal rank
are an interval whose common prefixes have ``MIN_RUN`` words or more. An interval with
suffixes of ``MIN_PAGES`` or more distinct pages is boilerplate, and the words it covers
go. A longer repeat is the union of such runs, so sorting deeper would find no more. The
unique runs between stay, a line each, with their punctuation.

A host is worked on by one task up to ``HOST_BYTES`` of HTML. Of larger hosts, suffixes
are named by hashes of their first ``MIN_RUN`` words, built by the same doubling, and
the names are grouped over the cluster instead of being ranked, with the same result.

Tags are found by a scanner that takes time in proportion to the page, whatever it
holds. A ``<`` that doesn't begin a tag, or begins one that another ``<`` or the end cuts
off, is text. Comments, and script, style, title, svg, noscript and template elements,
aren't visible; one of the last four that is self-closing or never closed hides nothing.

Defined results, one row a row: (page_id, host, text, words, removed_words). Null
HTML gives null text; HTML without visible words gives "". Pages whose URL has no
host (or null) share the host "". Rows of one page_id are one page, so repeated rows
don't make each other boilerplate; a null page_id is one page. A page shorter than
``MIN_RUN`` words is kept whole. Very long pages are taken whole. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

MIN_RUN = 8
MIN_PAGES = 2
HOST_BYTES = 192 << 20

_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "title")}
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
_PLAIN = re.compile(r"[^<>\"']*")
_VALUE = re.compile(r"=\s*\Z")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


class _Scanner:
    """Text pieces of a page. Searches that failed aren't made again, so all are linear in total."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.none: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        spot = self.page.find(what, at)
        if spot < 0:
            self.none.add(what)
        return spot

    def tag_end(self, at: int) -> int:
        """The place after the > of a tag whose name ends at ``at``, or -1 if it isn't one."""
        page = self.page
        while True:
            spot = _PLAIN.match(page, at).end()
            if spot == len(page) or page[spot] == "<":
                return -1
            if page[spot] == ">":
                return spot + 1
            at = spot + 1
            if _VALUE.search(page, max(0, spot - 32), spot):  # a quoted value; elsewhere a quote is a character
                close = self.find(page[spot], at)
                at = close + 1 if close >= 0 else at

    def element_end(self, name: str, at: int) -> int:
        """The place after the closing tag of an element that isn't visible; -1 if there is none."""
        if name in self.none:
            return -1
        close = _CLOSE[name].search(self.page, at)
        if not close:
            self.none.add(name)
        return close.end() if close else -1

    def run(self) -> str:
        page, out, at = self.page, self.out, 0
        while (spot := page.find("<", at)) >= 0:
            out.append(page[at:spot])
            at = spot + 1
            if page.startswith("!--", at):
                end = self.find("-->", at + 3)
                at = end + 3 if end >= 0 else len(page)
                out.append(" ")
            elif page.startswith(("!", "?"), at):
                end = self.find(">", at)
                at = end + 1 if end >= 0 else len(page)
                out.append(" ")
            elif (name := _NAME.match(page, at)) and (end := self.tag_end(name.end())) >= 0:
                at, tag = end, name[0].lower()
                if tag in _CLOSE and not page.endswith("/>", 0, end):
                    close = self.element_end(tag, end)
                    if close >= 0 or tag in ("script", "style"):
                        at = close if close >= 0 else len(page)
                        out.append(" ")
                        continue
                out.append("" if tag.lstrip("/") in _INLINE else "\n")
            else:
                out.append("<")
        out.append(page[at:])
        return "".join(out)


def visible(page: str | None) -> str | None:
    """The text of a page, a line for each block."""
    if page is None:
        return None
    text = entities.unescape(_Scanner(page).run())
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def _dense(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(x)
    x = x[order]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], x[1:] != x[:-1]]))
    return rank


def ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """For each place the rank of the suffix from it on among all, by its first ``depth``
    words; suffixes that are equal so far share a rank."""
    rank, done = _dense(words), 1
    while done < depth and len(rank):
        step = min(done, depth - done)
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1  # 0 past the end
        after += rank * (int(rank.max()) + 2)
        rank = _dense(after)
        done += step
    return rank


def keys(w: textvec.Words, depth: int) -> np.ndarray:
    """For each word the key of the depth words from it on, by doubling; not cut at text ends."""
    done, h = 0, np.zeros(len(w.hash), np.uint64)
    step, power = 1, w.hash.copy()
    left = depth
    while left:
        if left & 1:
            # h covers `done` words; append the block of `step` words that follows them
            tail = np.zeros_like(power)
            if done < len(power):
                tail[: len(power) - done] = power[done:]
            h = textvec.mix(h * np.uint64(0x9E3779B97F4A7C15) + tail)
            done += step
        left >>= 1
        if left:
            tail = np.zeros_like(power)
            if step < len(power):
                tail[: len(power) - step] = power[step:]
            power = textvec.mix(power * np.uint64(0xC2B2AE3D27D4EB4F) + tail)
            step *= 2
    return h


def _suffixes(texts: pa.Array, depth: int) -> tuple[textvec.Words, np.ndarray, np.ndarray]:
    """Words, and (index of word, key) of the suffixes of at least depth words."""
    w = textvec.words(texts)
    at = np.flatnonzero(np.arange(len(w.hash)) + depth <= w.first[1:][w.doc]) if len(w.hash) else np.zeros(0, np.int64)
    return w, at, keys(w, depth)[at]


def repeated(rank: np.ndarray, page: np.ndarray, min_pages: int) -> np.ndarray:
    """Which suffixes are in an interval of equal rank with min_pages distinct pages or more."""
    if not len(rank):
        return np.zeros(0, bool)
    pairs = np.sort(rank * (int(page.max()) + 1) + page)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    return np.bincount(pairs // (int(page.max()) + 1))[rank] >= min_pages


def _cut(w: textvec.Words, texts: pa.Array, gone: np.ndarray) -> tuple[list[str | None], list[int], list[int]]:
    """The texts without the words marked gone: kept runs a line each."""
    kept, sizes, removed = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        a, b = int(w.first[i]), int(w.first[i + 1])
        off = gone[a:b]
        n = int(off.sum())
        sizes.append(b - a)
        removed.append(n)
        if text is None or not n:
            kept.append(text)
            continue
        raw, base = text.encode(), int(w.text_off[i])
        edge = np.flatnonzero(np.diff(np.concatenate([[True], off, [True]]).astype(np.int8)))
        lines = []
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            begin = 0 if x == 0 else int(w.start[a + x]) - base
            end = len(raw) if y == b - a else int(w.start[a + y]) - base
            lines.append(raw[begin:end].decode().strip())
        kept.append("\n".join(lines))
    return kept, sizes, removed


def _rows(page_id: pa.Array, host: pa.Array, kept: list, sizes: list, removed: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [page_id, host, pa.array(kept, pa.string()), pa.array(sizes, pa.int32()), pa.array(removed, pa.int32())],
        names=["page_id", "host", "text", "words", "removed_words"],
    )


def _host(depth: int, min_pages: int):
    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("text", pa.string()), ("words", pa.int32()), ("removed_words", pa.int32())])
        parts = [p for b in table.to_batches() for p in textvec.slices(b, "text")]
        # repeated rows of a page are one page
        page = np.unique(np.asarray(pa.compute.fill_null(pa.chunked_array([p.column("page_id") for p in parts]), -(1 << 63))), return_inverse=True)[1].astype(np.int32)
        hashes, spots, owners, base, doc0 = [], [], [], 0, 0
        for p in parts:
            w = textvec.words(p.column("text"))
            hashes.append(w.hash)
            at = np.flatnonzero(np.arange(len(w.hash)) + depth <= w.first[1:][w.doc]) if len(w.hash) else np.zeros(0, np.int64)
            spots.append(at + base)
            owners.append(page[doc0 + w.doc[at]])
            base += len(w.hash)
            doc0 += p.num_rows
        at = np.concatenate(spots)
        rank = ranks(np.concatenate(hashes), depth)[at]
        del hashes, spots
        hit = at[repeated(rank, np.concatenate(owners).astype(np.int64), min_pages)]
        del rank, owners, at
        edge = np.zeros(base + depth + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + depth, -1)
        gone = np.cumsum(edge)[:base] > 0
        del edge
        out, base = [], 0
        for p in parts:
            w = textvec.words(p.column("text"), hashed=False)
            out.append(_rows(p.column("page_id"), p.column("host"), *_cut(w, p.column("text"), gone[base : base + len(w.start)])))
            base += len(w.start)
        return pa.Table.from_batches(out, schema)

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "html"):
            texts = pa.array(list(map(visible, part.column("html").to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), texts], names=["page_id", "host", "text"])


def _keyed(depth: int):
    """A row a suffix: its name, which host and first words give, its page and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                w, at, key = _suffixes(part.column("text"), depth)
                doc = w.doc[at]
                host, page, row = (np.asarray(part.column(c))[doc] for c in ("host_code", "page_code", "row"))
                key = textvec.mix(key + host.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(page), pa.array(row), pa.array((at - w.first[doc]).astype(np.int32))], names=["key", "page", "row", "at"])

    return run


def _cut_at(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                w = textvec.words(part.column("text"), hashed=False)
                edge = np.zeros(len(w.start) + depth + 1, np.int32)
                for i, marks in enumerate(part.column("marks").to_pylist()):
                    for mark in marks or []:
                        edge[w.first[i] + mark] += 1
                        edge[w.first[i] + mark + depth] -= 1
                gone = np.cumsum(edge)[: len(w.start)] > 0
                yield _rows(part.column("page_id"), part.column("host"), *_cut(w, part.column("text"), gone))

    return run


SCHEMA = "page_id long, host string, text string, words int, removed_words int"


def extract(pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, host_bytes: int = HOST_BYTES) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    large = [r.host for r in named.groupBy("host").agg(F.sum(F.octet_length("html")).alias("b")).filter(F.col("b") > host_bytes).select("host").collect()]
    texts = named.mapInArrow(_extract, "page_id long, host string, text string") if not large else None
    if not large:
        return texts.groupBy("host").applyInArrow(_host(min_run, min_pages), SCHEMA)
    is_large = F.col("host").isin(large)  # one name for each HOST_BYTES of input at most
    small = named.filter(~is_large).mapInArrow(_extract, "page_id long, host string, text string").groupBy("host").applyInArrow(_host(min_run, min_pages), SCHEMA)
    texts = named.filter(is_large).mapInArrow(_extract, "page_id long, host string, text string").withColumn("row", F.monotonically_increasing_id())
    texts = scratch.save(texts, "html-texts")  # parsed and numbered once
    coded = texts.select("row", "text", F.xxhash64("host").alias("host_code"), F.xxhash64("host", F.col("page_id").isNull(), "page_id").alias("page_code"))
    suffixes = coded.mapInArrow(_keyed(min_run), "key long, page long, row long, at int")
    # equal (name, page) are one when they leave a task
    found = suffixes.groupBy("key").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= min_pages).select(F.col("key").alias("k"))
    places = suffixes.select("key", "row", "at").join(found, F.col("key") == F.col("k"), "left_semi")
    marks = places.groupBy("row").agg(F.collect_list("at").alias("marks")).select(F.col("row").alias("r"), "marks")
    cut = texts.join(marks, F.col("row") == F.col("r"), "left").select("page_id", "host", "text", "marks").mapInArrow(_cut_at(min_run), SCHEMA)
    return small.unionAll(cut)
