"""Registered queries for the search engine, over the tables documents and labels, and the same in SQL.

The documents are indexed once a session and data folder: field body from text, and
fields lang and source; label good for quality 1, toxic for toxic 1.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions.snippets import snippets
from .functions.tokens import MAX_TOKEN_BYTES, TOKEN, index_tokens
from .functions.tokens import tokens as all_tokens
from .operators import postings as post
from .operators.index import Entry, Index, IndexStateError
from .plans.ast import And, Empty, Not, Term, downcase
from .plans.parser import ParseError, parse
from .sources import files

FIELDS = {"body": "text", "lang": "lang", "source": "source"}
_indexes: dict[tuple[str, str], Index] = {}


def build_index(spark: SparkSession, sf_dir: str) -> Index:
    index = Index.create(spark, f"{storage.shared_dir(spark)}/search-{uuid.uuid4().hex}")
    index.add_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), FIELDS, ["text", "lang", "source"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1").select(F.lit("good").alias("label"), "doc_id")
    index.add_labels(good.unionAll(labels.filter("toxic = 1").select(F.lit("toxic").alias("label"), "doc_id")))
    return index


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not _indexes[key].folder.exists("meta.json"):
        _indexes[key] = build_index(spark, sf_dir)
    return _indexes[key]


#: query strings by name, with the condition on a document d in SQL
SEARCHES: dict[str, tuple[str, str]] = {}


def _has(word: str, field: str = "body") -> str:
    return f"EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = d.doc_id AND field = '{field}' AND word = '{word}')"


def _phrase(*words: str, field: str = "body") -> str:
    tables = ", ".join(f"tok t{i}" for i in range(len(words)))
    on = " AND ".join(f"t{i}.doc_id = d.doc_id AND t{i}.field = '{field}' AND t{i}.word = '{w}' AND t{i}.pos = t0.pos + {i}" for i, w in enumerate(words))
    return f"d.doc_id IN (SELECT t0.doc_id FROM {tables} WHERE {on.replace('t0.doc_id = d.doc_id', 'true').replace('.doc_id = d.doc_id', '.doc_id = t0.doc_id')})"


def _label(name: str) -> str:
    column = {"good": "quality", "toxic": "toxic"}[name]
    return f"d.doc_id IN (SELECT doc_id FROM labels WHERE {column} = 1)"


the, of, and_, to, in_, on = (_has(w) for w in ("the", "of", "and", "to", "in", "on"))
SEARCHES |= {
    "term": ("the", the),
    "fielded_term": ("lang:en", _has("en", "lang")),
    "conj": ("the of and", f"{the} AND {of} AND {and_}"),
    "disj": ("the OR zzz", f"{the} OR {_has('zzz')}"),
    "disj_overlap": ("the OR of OR and", f"{the} OR {of} OR {and_}"),
    "prec": ("in the OR of", f"{in_} AND ({the} OR {of})"),
    "nested": ("(the OR of) -(and to)", f"({the} OR {of}) AND NOT ({and_} AND {to})"),
    "phrase2": ('"of the"', _phrase("of", "the")),
    "phrase3": ('"the of the"', _phrase("the", "of", "the")),
    "phrase_field": ('lang:"en"', _has("en", "lang")),
    "phrase_conj": ('"of the" and', f"{_phrase('of', 'the')} AND {and_}"),
    "neg": ("-the", f"NOT {the}"),
    "double_neg": ("--the", the),
    "neg_group": ("-(the OR of)", f"NOT ({the} OR {of})"),
    "conj_neg": ("the -of", f"{the} AND NOT {of}"),
    "phrase_neg": ('the -"of the"', f"{the} AND NOT {_phrase('of', 'the')}"),
    "every": ("*", "true"),
    "neg_every": ("-*", "false"),
    "every_conj": ("the *", the),
    "empty": ("", "false"),
    "field_group": ("lang:(en OR de) the", f"({_has('en', 'lang')} OR {_has('de', 'lang')}) AND {the}"),
    "label": ("~good", _label("good")),
    "neg_label": ("~good -~toxic", f"{_label('good')} AND NOT {_label('toxic')}"),
    "label_conj": ("~toxic the", f"{_label('toxic')} AND {the}"),
}

_TOKEN_SQL = TOKEN.replace("'", "''")


def _field_tokens_sql(field: str, column: str) -> str:
    kept = f"list_filter(regexp_extract_all({column}, '{_TOKEN_SQL}'), lambda w: strlen(w) <= {MAX_TOKEN_BYTES})"
    return f"coalesce(list_transform({kept}, lambda w: {{'field': '{field}', 'word': w}}), [])"


TOKENS_SQL = f"""lists AS (SELECT doc_id, {" || ".join(_field_tokens_sql(f, c) for f, c in FIELDS.items())} AS l FROM documents WHERE doc_id IS NOT NULL),
tok AS (SELECT doc_id, (pos - 1)::INTEGER AS pos, e.field AS field, e.word AS word FROM (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM lists))"""


def _search(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: index_of(spark, sf_dir).find(text)


def page(text: str, n: int, skip: int) -> Callable[[SparkSession, str], DataFrame]:
    """The page of n results after skip of them, found by its cursor."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cursor = index_of(spark, sf_dir).cursor(text)
        if skip:
            cursor.next(skip)
        return spark.createDataFrame([(i,) for i in cursor.next(n)], "doc_id long")

    return run


def count_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(index_of(spark, sf_dir).count("the")).cast("long").alias("n"))


def count_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).find("the -of").agg(F.count("*").alias("n"))


def num_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(index_of(spark, sf_dir).size()).cast("long").alias("n"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats()


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).label_stats()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(index_tokens("text")).alias("pos", "word"))


def entry_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return post.entry_sizes(docs.select("doc_id", post.field_tokens(FIELDS).alias("tokens")))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings().select("field", "word", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def label_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds x to all labelled documents of an index of its own, removes it from the toxic ones, adds it again to those that are good, too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = new_index(spark)
    index.add_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"lang": "lang"})
    x = lambda where: labels.filter(where).select(F.lit("x").alias("label"), "doc_id")
    index.add_labels(x("true"))
    index.remove_labels(x("toxic = 1"))
    index.add_labels(x("toxic = 1 and quality = 1"))
    return index.find("~x")


def new_index(spark: SparkSession) -> Index:
    return Index.create(spark, f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of conversations: a document each, whose turns are added one after the other to the field of their role."""
    index = new_index(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    index.add_entries(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("field"), "text"))
    return index.postings().select("field", "word", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def single_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents that are put together string by string, token by token and from a file."""
    index = new_index(spark)
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").toLocalIterator():
        with tempfile.NamedTemporaryFile("w") as f:  # read by this process, before the next step
            f.write(f"in {r.r_name}")
            f.flush()
            index.add_entry(Entry().add_string("name", f"the {r.r_name} region").add_token("key", f"key {r.r_regionkey}").add_file("name", f.name))
    return index.postings().select("field", "word", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of an index sees after each addition."""
    index = new_index(spark)
    reader, seen = Index.load(spark, index.path), [(0, 0, 0)]
    for k, (table, column) in enumerate([("region", "r_name"), ("nation", "n_name")], 1):
        index.add_documents(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column), {"body": column})
        seen.append((k, reader.size(), reader.count("-ASIA")))
    return spark.createDataFrame(seen, "step int, n long, without long")


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}"

    def fails(step: Callable) -> bool:
        try:
            step(spark, path)
        except IndexStateError:
            return True
        return False

    seen = [("missing", Index.exists(spark, path)), ("load missing fails", fails(Index.load))]
    seen += [("create fails", fails(Index.create)), ("created", Index.exists(spark, path)), ("create again fails", fails(Index.create)), ("load fails", fails(Index.load)), ("open fails", fails(Index.open))]
    Index.load(spark, path).close()
    Index.delete(spark, path)
    return spark.createDataFrame([*seen, ("deleted", not Index.exists(spark, path))], "step string, holds boolean")


def cursor_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of a query with their places, from a cursor at its start to its end."""
    return index_of(spark, sf_dir).cursor("the -of").rest()


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).dump().select("field", "word", "doc_id", F.size("positions").alias("n"))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).stats().select("docs", "terms", "postings", "occurrences")


def count_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(index_of(spark, sf_dir).count("~good")).cast("long").alias("n"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index_of(spark, sf_dir).matches('"of the" -toxic')
    return found.select("doc_id", "field", "word", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of raw pages, and how many of them are too long to be indexed."""
    pages = storage.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return pages.select("page_id", F.size(all_tokens("html")).alias("n"), F.size(F.filter(all_tokens("html"), lambda t: F.octet_length(t) > MAX_TOKEN_BYTES)).alias("long"))


def downcased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).find(downcase("(THE OR Of) AND"))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that is put together from parts, one of them with its field replaced."""
    the, of, en = Term("body", "the"), Term("body", "of"), Term("body", "en").with_field("lang")
    return index_of(spark, sf_dir).find(Empty() & (the | of) & Not((And().add(en).add(the),)))


#: queries with their rendering, or None for those that can't be parsed
PARSED: list[tuple[str, str | None]] = [
    ("", "<EMPTY>"), ("i eat mice", '(AND body:"i" body:"eat" body:"mice")'), ("a OR b c", '(AND (OR body:"a" body:"b") body:"c")'), ("~l -x *", '(AND ~l (NOT body:"x") <EVERY>)'),
    ('f:"a b" g:(c d)', '(AND (PHRASE f:"a" f:"b") (AND g:"c" g:"d"))'), ("OR a", None), ("a OR", None), ('""', None), ("a:b:c", None), ("a:-b", None), ("a:*", None), ("(a", None), ('"a OR b"', None),
]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rendered(text: str) -> str | None:
        try:
            return str(parse(text))
        except ParseError:
            return None

    return spark.createDataFrame([(q, rendered(q)) for q, _ in PARSED], "query string, rendering string")


def make_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word as a query of one word: the sampler with nothing left out."""
    return files.random_queries(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", 2.0, 1)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, each written to a file of its own, indexed and read back."""
    path = f"{storage.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_nationkey").write.partitionBy("n_nationkey").text(path)
    index = new_index(spark)
    files.index_text_files(index, f"{path}/*/*.txt")
    return index.with_columns(index.find("*")).select("body")


def mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, written as mailboxes, indexed, and read back by the label of mails."""
    path = f"{storage.shared_dir(spark)}/mail-{uuid.uuid4().hex}"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns.select(F.concat(F.lit("From "), "role", F.lit("\n"), "text")).write.text(path)
    index = new_index(spark)
    files.index_mbox(index, path)
    return index.with_columns(index.find("~inbox")).select(F.rtrim(F.col("body"), F.lit("\n")).alias("body"))


def term_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).find(parse("the of").map_terms(lambda field, word: word.upper()))


def _snippets(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _texts(spark, sf_dir)
        spans = docs.select("doc_id", F.explode(snippets(parse(text), "body", F.col("text"), None)).alias("s"))
        return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _search(text) for name, (text, _) in SEARCHES.items()}
QUERIES |= {
    "limit": page("the", 10, 0),
    "page2": page("the", 10, 10),
    "count_term": count_term,
    "count_complex": count_complex,
    "num_docs": num_docs,
    "term_stats": term_stats,
    "label_stats": label_stats,
    "tokens": tokens,
    "entry_size": entry_size,
    "postings": postings,
    "label_mutation": label_mutation,
    "term_map": term_map,
    "entries": entries,
    "single_entries": single_entries,
    "growth": growth,
    "lifecycle": lifecycle,
    "cursor_end": cursor_end,
    "dump": dump,
    "info": info,
    "count_label": count_label,
    "matches": matches,
    "page_tokens": page_tokens,
    "downcased": downcased,
    "built": built,
    "parsed": parsed,
    "make_queries": make_queries,
    "text_files": text_files,
    "mailboxes": mailboxes,
    "snippets": _snippets("the OR of"),
    "snippet_phrase": _snippets('"of the"'),
}


def _sql(condition: str) -> str:
    with_ = f"WITH {TOKENS_SQL} " if "tok" in condition else ""
    return f"{with_}SELECT d.doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d WHERE {condition}"


#: The words of body with their byte offsets and numbers, and what lies between them.
_SPANS_SQL = f"""WITH pieces AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN_SQL}|(?s:.)') AS l FROM documents),
placed AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM pieces),
summed AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM placed),
spans AS (SELECT doc_id, piece AS word, (stop - strlen(piece))::INTEGER AS start, stop::INTEGER AS stop,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM summed WHERE regexp_full_match(piece, '{_TOKEN_SQL}'))"""

SQL: dict[str, str] = {name: _sql(condition) for name, (_, condition) in SEARCHES.items()}
SQL |= {
    "limit": f"{_sql(the)} ORDER BY doc_id DESC LIMIT 10",
    "page2": f"{_sql(the)} ORDER BY doc_id DESC LIMIT 10 OFFSET 10",
    "count_term": f"WITH {TOKENS_SQL} SELECT count(DISTINCT doc_id) AS n FROM tok WHERE field = 'body' AND word = 'the'",
    "count_complex": f"WITH {TOKENS_SQL} SELECT count(*) AS n FROM documents d WHERE {the} AND NOT {of}",
    "num_docs": "SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL",
    "term_stats": f"WITH {TOKENS_SQL} SELECT field, word, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM tok GROUP BY ALL",
    "label_stats": "SELECT label, count(DISTINCT doc_id) AS df FROM (SELECT 'good' AS label, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1) GROUP BY label",
    "tokens": f"WITH {TOKENS_SQL} SELECT doc_id, pos, word FROM tok WHERE field = 'body'",
    "entry_size": f"WITH {TOKENS_SQL} SELECT doc_id, len(l)::INTEGER AS n_tokens FROM lists",
    "postings": f"WITH {TOKENS_SQL} SELECT field, word, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY ALL",
    "label_mutation": "SELECT doc_id FROM labels GROUP BY doc_id HAVING max(toxic) = 0 OR max(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) = 1",
    "term_map": _sql(f"{_has('THE')} AND {_has('OF')}"),
    "snippets": f"{_SPANS_SQL} SELECT doc_id, start, stop AS \"end\" FROM spans WHERE word IN ('the', 'of')",
    "snippet_phrase": f"""{_SPANS_SQL} SELECT a.doc_id, a.start AS start, b.stop AS "end" FROM spans a JOIN spans b ON b.doc_id = a.doc_id AND b.k = a.k + 1
WHERE a.word = 'of' AND b.word = 'the'""",
}

def _positions_sql(tokens: str) -> str:
    return f"SELECT field, word, doc_id, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM {tokens} GROUP BY ALL"


_KEPT = f"list_filter(regexp_extract_all(text, '{_TOKEN_SQL}'), lambda w: strlen(w) <= {MAX_TOKEN_BYTES})"
SQL |= {
    "entries": f"""WITH turns AS (SELECT conv_id AS doc_id, turn, role AS field, unnest({_KEPT}) AS word, generate_subscripts({_KEPT}, 1) AS i FROM conversations),
tok AS (SELECT doc_id, field, word, row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) - 1 AS pos FROM turns) {_positions_sql("tok")}""",
    "single_entries": f"""WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS doc_id, r_name, r_regionkey FROM region),
lists AS (SELECT doc_id, 'the ' || r_name || ' region' AS text, 0 AS part, 'name' AS field FROM r UNION ALL SELECT doc_id, 'in ' || r_name, 2, 'name' FROM r),
words AS (SELECT doc_id, part, field, unnest({_KEPT}) AS word, generate_subscripts({_KEPT}, 1) AS i FROM lists UNION ALL SELECT doc_id, 1, 'key', 'key ' || r_regionkey, 1 FROM r),
tok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, i) - 1 AS pos FROM words) {_positions_sql("tok")}""",
    "growth": """WITH n AS (SELECT 0 AS step, 0 AS rows, 0 AS asia UNION ALL SELECT 1, (SELECT count(*) FROM region), (SELECT count(*) FROM region WHERE r_name = 'ASIA')
UNION ALL SELECT 2, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), (SELECT count(*) FROM region WHERE r_name = 'ASIA') + (SELECT count(*) FROM nation WHERE n_name = 'ASIA'))
SELECT step::INTEGER AS step, rows AS n, rows - asia AS without FROM n""",
    "lifecycle": "SELECT * FROM (VALUES ('missing', false), ('load missing fails', true), ('create fails', false), ('created', true), ('create again fails', true), ('load fails', false), ('open fails', false), ('deleted', true)) t(step, holds)",
    "cursor_end": f"SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS place, doc_id FROM ({_sql(f'{the} AND NOT {of}')})",
    "dump": f"WITH {TOKENS_SQL} SELECT field, word, doc_id, count(*)::INTEGER AS n FROM tok GROUP BY ALL",
    "info": f"WITH {TOKENS_SQL}, posts AS (SELECT field, word, doc_id, count(*) AS n FROM tok GROUP BY ALL) SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS docs, (SELECT count(DISTINCT (field, word)) FROM posts) AS terms, count(*) AS postings, sum(n)::BIGINT AS occurrences FROM posts",
    "count_label": "SELECT count(DISTINCT doc_id) AS n FROM labels WHERE quality = 1",
    "matches": f"WITH {TOKENS_SQL}, found AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) d WHERE {_phrase('of', 'the')} AND NOT {_has('toxic')}), own AS (SELECT * FROM tok WHERE field = 'body' AND word IN ('of', 'the') AND doc_id IN (SELECT doc_id FROM found)) {_positions_sql('own')}",
    "page_tokens": f"SELECT page_id, len(l)::INTEGER AS n, len(list_filter(l, lambda w: strlen(w) > {MAX_TOKEN_BYTES}))::INTEGER AS long FROM (SELECT page_id, regexp_extract_all(html, '{_TOKEN_SQL}') AS l FROM pages)",
    "downcased": _sql(f"({the} OR {of}) AND {and_}"),
    "built": _sql(f"({the} OR {of}) AND NOT ({_has('en', 'lang')} AND {the})"),
    "parsed": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else "'" + x + "'" for x in row) + ")" for row in PARSED) + ") t(query, rendering)",
    "make_queries": f"SELECT unnest(regexp_extract_all(text, '{_TOKEN_SQL}')) AS query FROM documents",
    "text_files": "SELECT n_name || chr(10) AS body FROM nation",
    "mailboxes": """WITH mails AS (SELECT unnest(string_split(role || chr(10) || text, chr(10) || 'From ')) AS mail FROM conversations)
SELECT rtrim(translate(regexp_replace(mail, '^[^\n]*\n?', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS body FROM mails""",
}
