"""The document tokenizer, as column expressions.

A word starts and ends with a character that is no blank and no ASCII punctuation and
holds anything but blanks and angle brackets between; a number is an optional minus,
digits and an optional fraction. Case is kept. All non-ASCII characters are word
characters. Indexing drops tokens of more than ``MAX_TOKEN_BYTES`` bytes, which take
no position.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r" \t\r\n"
_PUNCT = r"!-/:-@\[-`{-~"
#: Leftmost-first form of a longest-match lexer; the order of the branches for numbers matters.
TOKEN = "|".join(
    [
        rf"[^{_BLANK}{_PUNCT}0-9](?:[^{_BLANK}<>]*[^{_BLANK}{_PUNCT}])?",
        r"-[0-9]+(?:\.[0-9]*)?",
        rf"[0-9]+[^{_BLANK}<>0-9][^{_BLANK}<>]*[^{_BLANK}{_PUNCT}]",
        rf"[0-9]+[^{_BLANK}{_PUNCT}0-9]",
        r"[0-9]+\.?",
    ]
)
MAX_TOKEN_BYTES = 50

_IN_BYTES = re.compile(TOKEN.encode())


def tokens(text: Column | str) -> Column:
    """array<string> of all tokens of a text; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def index_tokens(text: Column | str) -> Column:
    """The tokens that are indexed; their places in the array are their positions."""
    return F.filter(tokens(text), lambda t: F.octet_length(t) <= MAX_TOKEN_BYTES)


def ascii_lower(text: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def token_matches(text: str | bytes) -> Iterator[re.Match[bytes]]:
    """The tokens one after the other, with their places in bytes."""
    return _IN_BYTES.finditer(text.encode() if isinstance(text, str) else text)


def token_spans(text: str | bytes) -> list[tuple[bytes, int, int]]:
    """(token, start, end) in bytes, for use outside of Spark."""
    return [(m[0], m.start(), m.end()) for m in token_matches(text)]


def raw_tokens(text: str) -> list[bytes]:
    """All tokens of a text, as bytes."""
    return _IN_BYTES.findall(text.encode())


def local_tokens(text: str) -> list[str]:
    return [t.decode() for t, _, _ in token_spans(text)]
