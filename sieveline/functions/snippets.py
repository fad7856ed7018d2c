"""Byte spans of a text at which a query matches.

The scan goes from left to right, takes the first match at each token and goes on
after it. Terms and phrases match words of the given field; a conjunction or
disjunction matches where any child does, the first that does counting; labels,
negations and the empty and the all-matching query never match. Tokens of any length
count here.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import And, Or, Phrase, Query, Term
from .tokens import token_matches

MAX_SNIPPETS = 10
SPANS = "array<struct<start:int,end:int>>"
#: Tokens of a text that are looked at at once.
WINDOW = 4096


def match_length(query: Query, field: str, words: list[bytes], at: int) -> int:
    """How many tokens from ``at`` on match, or 0."""
    if isinstance(query, Term):
        return int(query.field == field and words[at] == query.word.encode())
    if isinstance(query, (And, Or)):
        return next((n for c in query.children if (n := match_length(c, field, words, at))), 0)
    if isinstance(query, Phrase):
        terms = query.children
        if not terms or terms[0].field != field or at + len(terms) > len(words):
            return 0
        return len(terms) if all(words[at + i] == t.word.encode() for i, t in enumerate(terms)) else 0
    return 0


def first_words(query: Query, field: str) -> set[bytes]:
    """The words at which a match can begin."""
    if isinstance(query, Term):
        return {query.word.encode()} if query.field == field else set()
    if isinstance(query, (And, Or)):
        return set().union(*[first_words(c, field) for c in query.children])
    return first_words(query.children[0], field) if isinstance(query, Phrase) and query.children else set()


def each_snippet(query: Query, field: str, text: str | bytes) -> Iterator[tuple[int, int]]:
    """(start, end) in bytes, end exclusive, of one match after the other; holds ``WINDOW`` tokens of the text and as many as a phrase has."""
    tokens, begin = token_matches(text), first_words(query, field)
    longest = max([len(n.children) for n in query.walk() if isinstance(n, Phrase)], default=1)
    found: list[re.Match[bytes]] = []
    at, more = 0, bool(begin)
    while more:
        found, at = found[at:], 0
        more = len(found) < len(found := found + list(islice(tokens, WINDOW)))
        words = [m[0] for m in found]
        to = len(words) - longest + 1 if more else len(words)  # later tokens may lack some of their phrase
        while at < to:
            n = match_length(query, field, words, at) if words[at] in begin else 0
            if n:
                yield found[at].start(), found[at + n - 1].end()
            at += n or 1


def snippet_spans(query: Query, field: str, text: str | bytes | None, limit: int | None = MAX_SNIPPETS) -> list[tuple[int, int]]:
    """The spans of the first ``limit`` matches (of all, if None); a null text has none."""
    return [] if text is None else list(islice(each_snippet(query, field, text), limit))


def snippet_file(query: Query, field: str, path: str, limit: int | None = MAX_SNIPPETS) -> list[tuple[int, int]]:
    """The spans of a file of this machine."""
    with open(path, "rb") as f:
        return snippet_spans(query, field, f.read(), limit)


def snippets(query: Query, field: str, text: Column | str, limit: int | None = MAX_SNIPPETS) -> Column:
    """The spans as a column. The greedy scan is sequential, so it runs in Arrow batches in Python,
    which holds one text at a time and the numbers of the batch's spans."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        ends, starts, stops = array("i", [0]), array("i"), array("i")
        for t in texts:
            if t.is_valid:
                for start, stop in islice(each_snippet(query, field, t.as_py()), limit):
                    starts.append(start)
                    stops.append(stop)
            ends.append(len(starts))
        number = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
        return pa.ListArray.from_arrays(number(ends), pa.StructArray.from_arrays([number(starts), number(stops)], names=["start", "end"]))

    return scan(text)


def excerpt(text: str, span: tuple[int, int], padding: int = 100) -> str:
    """The text around a span, with so many bytes on either side."""
    raw = text.encode()
    return raw[max(0, span[0] - padding) : span[1] + padding].decode(errors="ignore")
