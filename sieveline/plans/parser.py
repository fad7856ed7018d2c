"""The query language.

    query   nothing, or atoms and disjunctions side by side, which all must match
    disj    atom OR atom OR ...  (binds tighter than juxtaposition)
    atom    word | field:word | "a phrase" | field:"a phrase" | (query) | field:(query)
            | -atom | ~label | *

A word starts with anything but blanks and ``( ) " ~ : * -`` and goes on with anything
but blanks and ``( ) " :``. Words are taken as they are, without folding or tokenising.
"""

from __future__ import annotations

import re

from .ast import And, Empty, Every, Label, Not, Or, Phrase, Query, Term

_WORD = re.compile(r'[^ \t\n()"~:*\-][^ \t\n()":]*')


class ParseError(ValueError):
    """The query string isn't in the language."""


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, place) of each token; kind is WORD, OR or the character itself."""
    found, at = [], 0
    while at < len(text):
        if text[at] in " \t\n":
            at += 1
            continue
        m = _WORD.match(text, at)
        value = m[0] if m else text[at]
        found.append((("OR" if value == "OR" else "WORD") if m else value, value, at))
        at += len(value)
    return found


class _Parser:
    def __init__(self, text: str, field: str):
        self.text, self.field, self.tokens, self.at = text, field, lex(text), 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else None

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            place = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
            line = self.text.count("\n", 0, place) + 1
            raise ParseError(f"parse error: line {line}: expected {kind!r} at character {place}, found {self.peek() or 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self) -> Query:
        whole: Query = Empty()
        while self.peek() not in (None, ")"):
            part = self.disjunction()
            if isinstance(whole, (Empty, And)):
                whole = whole.add(part)
            elif not isinstance(part, Empty):
                whole = And().add(whole).add(part)
        return whole

    def disjunction(self) -> Query:
        first = self.atom()
        if self.peek() != "OR":
            return first
        either = Or().add(first)
        while self.peek() == "OR":
            self.at += 1
            either = either.add(self.atom())
        return either

    def atom(self) -> Query:
        kind = self.peek()
        if kind == "-":
            self.at += 1
            return Not().add(self.atom())
        if kind == "~":
            self.at += 1
            return Label(self.take("WORD"))
        if kind == "*":
            self.at += 1
            return Every()
        if kind == "(":
            return self.parens()
        if kind == '"':
            return self.phrase()
        word = self.take("WORD")
        if self.peek() != ":":
            return Term(self.field, word)
        self.at += 1
        if self.peek() == "(":
            return self.parens().with_field(word)
        if self.peek() == '"':
            return self.phrase().with_field(word)
        return Term(word, self.take("WORD"))

    def parens(self) -> Query:
        self.take("(")
        inner = self.query()
        self.take(")")
        return inner

    def phrase(self) -> Query:
        self.take('"')
        words: Query = Phrase().add(Term(self.field, self.take("WORD")))
        while self.peek() != '"':
            words = words.add(Term(self.field, self.take("WORD")))
        self.at += 1
        return words


def parse(text: str, default_field: str = "body") -> Query:
    parser = _Parser(text, default_field)
    whole = parser.query()
    if parser.peek() is not None:
        parser.take("the end")
    return whole
