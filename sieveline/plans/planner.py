"""Query trees as DataFrames of document ids.

Any boolean tree is one aggregation: the postings and labels of its leaves are read
(which the clustering of the postings keeps small), grouped by document into one flag
for each leaf, and the tree is evaluated over the flags as one boolean expression. So a
query costs one shuffle of doc_ids at most, whatever its depth; the table of documents
is read only if the tree can hold for a document that has none of its leaves. Phrases
are flags too: the positions of their words are gathered in the same aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ast import And, Empty, Every, Label, Not, Or, Phrase, Query, QueryError, Term


def check(query: Query) -> None:
    for node in query.walk():
        if isinstance(node, Not) and len(node.children) != 1:
            raise QueryError("a negation takes exactly one query that isn't empty")
        if isinstance(node, Phrase) and not all(isinstance(c, Term) for c in node.children):
            raise QueryError("a phrase is made of terms")


def simplify(query: Query) -> Query:
    """An equivalent tree: constants folded, double negations and single children gone, repeats dropped."""
    if isinstance(query, Not):
        inner = simplify(query.children[0])
        if isinstance(inner, Not):
            return inner.children[0]
        return {Empty: Every(), Every: Empty()}.get(type(inner), Not((inner,)))
    if isinstance(query, And):
        parts = list(dict.fromkeys(simplify(c) for c in query.children))
        if not parts or any(isinstance(p, Empty) for p in parts):
            return Empty()
        parts = [p for p in parts if not isinstance(p, Every)]
        return Every() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))
    if isinstance(query, Or):
        parts = [p for p in dict.fromkeys(simplify(c) for c in query.children) if not isinstance(p, Empty)]
        if any(isinstance(p, Every) for p in parts):
            return Every()
        return Empty() if not parts else parts[0] if len(parts) == 1 else Or(tuple(parts))
    if isinstance(query, Phrase):
        return Empty() if not query.children else query.children[0] if len(query.children) == 1 else query
    return query


def holds_without_leaves(query: Query) -> bool:
    """Whether a document with none of the tree's terms and labels matches."""
    if isinstance(query, Every):
        return True
    if isinstance(query, Not):
        return not holds_without_leaves(query.children[0])
    if isinstance(query, And):
        return all(map(holds_without_leaves, query.children)) and bool(query.children)
    return isinstance(query, Or) and any(map(holds_without_leaves, query.children))


def _is(term: Term) -> Column:
    return (F.col("field") == term.field) & (F.col("word") == term.word)


def plan(query: Query, docs: DataFrame, postings: DataFrame, labels: DataFrame) -> DataFrame:
    """DataFrame[doc_id] of the matching documents, each once, in no order.

    docs(doc_id), postings(field, word, doc_id, positions) with one row for each
    (field, word, doc_id), labels(label, doc_id) as they are now.
    """
    check(query)
    query = simplify(query)
    if isinstance(query, Empty):
        return docs.select("doc_id").limit(0)
    if isinstance(query, Every):
        return docs.select("doc_id")
    if isinstance(query, Term):
        return postings.filter(_is(query)).select("doc_id")
    if isinstance(query, Label):
        return labels.filter(F.col("label") == query.name).select("doc_id").distinct()

    nodes = list(query.walk())
    in_phrases = {t for n in nodes if isinstance(n, Phrase) for t in n.children}
    terms = list(dict.fromkeys(n for n in nodes if isinstance(n, Term)))
    names = list(dict.fromkeys(n for n in nodes if isinstance(n, Label)))
    flags: dict[Query, str] = {leaf: f"f{i}" for i, leaf in enumerate([*terms, *names])}
    places = {t: f"p{i}" for i, t in enumerate(terms) if t in in_phrases}

    read = []
    if terms:
        # words by field, so that the filters reach the Parquet statistics
        by_field: dict[str, list[str]] = {}
        for t in terms:
            by_field.setdefault(t.field, []).append(t.word)
        wanted = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("word").isin(w) for f, w in by_field.items()])
        leaf = reduce(lambda c, t: c.when(_is(t), F.lit(flags[t])), terms[1:], F.when(_is(terms[0]), F.lit(flags[terms[0]])))
        positions = F.when(leaf.isin(*[flags[t] for t in places]), F.col("positions")) if places else F.lit(None).cast("array<int>")
        read.append(postings.filter(wanted).select("doc_id", leaf.alias("leaf"), positions.alias("positions")))
    if names:
        leaf = reduce(lambda c, n: c.when(F.col("label") == n.name, F.lit(flags[n])), names[1:], F.when(F.col("label") == names[0].name, F.lit(flags[names[0]])))
        read.append(labels.filter(F.col("label").isin([n.name for n in names])).select("doc_id", leaf.alias("leaf"), F.lit(None).cast("array<int>").alias("positions")))
    rows = reduce(DataFrame.unionAll, read)
    has = [F.max(F.col("leaf") == f).alias(f) for f in flags.values()]
    at = [F.first(F.when(F.col("leaf") == flags[t], F.col("positions")), ignorenulls=True).alias(p) for t, p in places.items()]
    found = rows.groupBy("doc_id").agg(*has, *at)
    if holds_without_leaves(query):
        found = docs.select("doc_id").join(found, "doc_id", "left")

    def test(node: Query) -> Column:
        if node in flags:
            return F.coalesce(F.col(flags[node]), F.lit(False))
        if isinstance(node, Every):
            return F.lit(True)
        if isinstance(node, Not):
            return ~test(node.children[0])
        if isinstance(node, Phrase):
            first, *rest = node.children

            def follows(p: Column) -> Column:
                return reduce(lambda a, b: a & b, [F.array_contains(F.col(places[t]), p + (i + 1)) for i, t in enumerate(rest)])

            return F.coalesce(F.exists(F.col(places[first]), follows), F.lit(False))
        parts = map(test, node.children)
        return reduce(lambda a, b: a & b, parts) if isinstance(node, And) else reduce(lambda a, b: a | b, parts)

    return found.filter(test(query)).select("doc_id")
