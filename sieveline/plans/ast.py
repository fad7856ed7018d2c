"""Immutable query trees.

``str(query)`` gives the canonical rendering; ``a & b`` and ``a | b`` combine two
queries without flattening; ``map_terms`` rewrites the words of terms; ``with_field``
overrides the field of every term below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace


class QueryError(ValueError):
    """A query that can't be run."""


@dataclass(frozen=True)
class Query:
    @property
    def children(self) -> tuple[Query, ...]:
        return ()

    def _with_children(self, children: tuple[Query, ...]) -> Query:
        return self

    def add(self, child: Query) -> Query:
        """This query with one more child; an empty query on either side is dropped."""
        if isinstance(self, Empty):
            return child
        if isinstance(child, Empty):
            return self
        if not isinstance(self, _Group):
            raise QueryError(f"{type(self).__name__} takes no children")
        return self._with_children((*self.children, child))

    def map_terms(self, change: Callable[[str, str], str | None]) -> Query:
        """Words changed by ``change(field, word)``; None keeps a word, labels stay."""
        return self._with_children(tuple(c.map_terms(change) for c in self.children))

    def with_field(self, field: str) -> Query:
        return self._with_children(tuple(c.with_field(field) for c in self.children))

    def walk(self) -> Iterator[Query]:
        yield self
        for child in self.children:
            yield from child.walk()

    def __and__(self, other: Query) -> Query:
        return And().add(self).add(other)

    def __or__(self, other: Query) -> Query:
        return Or().add(self).add(other)


@dataclass(frozen=True)
class Term(Query):
    """Documents that have exactly this word in this field."""

    field: str
    word: str

    def map_terms(self, change: Callable[[str, str], str | None]) -> Query:
        word = change(self.field, self.word)
        return self if word is None else Term(self.field, word)

    def with_field(self, field: str) -> Query:
        return Term(field, self.word)

    def __str__(self) -> str:
        return f'{self.field}:"{self.word}"'


@dataclass(frozen=True)
class Label(Query):
    """Documents that carry a label now."""

    name: str

    def __str__(self) -> str:
        return f"~{self.name}"


@dataclass(frozen=True)
class Empty(Query):
    """No document."""

    def __str__(self) -> str:
        return "<EMPTY>"


@dataclass(frozen=True)
class Every(Query):
    """All documents."""

    def __str__(self) -> str:
        return "<EVERY>"


@dataclass(frozen=True)
class _Group(Query):
    parts: tuple[Query, ...] = ()

    @property
    def children(self) -> tuple[Query, ...]:
        return self.parts

    def _with_children(self, children: tuple[Query, ...]) -> Query:
        return replace(self, parts=children)

    def __str__(self) -> str:
        return "(" + " ".join([_NAMES[type(self)], *map(str, self.parts)]) + ")"


class And(_Group):
    """Documents that match all children; none without children."""


class Or(_Group):
    """Documents that match any child."""


class Phrase(_Group):
    """Documents with the terms at consecutive positions."""


class Not(_Group):
    """Documents that don't match the one child."""


_NAMES = {And: "AND", Or: "OR", Phrase: "PHRASE", Not: "NOT"}


def downcase(text: str) -> str:
    """The query string in lower case but for the keyword OR."""
    from .parser import lex

    out, at = [], 0
    for kind, value, start in lex(text):
        end = start + len(value)
        out.append(text[at:start] + (value.lower() if kind == "WORD" else value))
        at = end
    return "".join(out) + text[at:]
