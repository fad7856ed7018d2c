import io
import random

import pytest

from sieveline import cli
from sieveline.operators import labels as label_ops
from sieveline.operators.index import Entry, Index, IndexStateError, VersionError
from sieveline.plans.ast import And, Empty, Every, Label, Not, Or, Phrase, QueryError, Term
from sieveline.plans.parser import parse
from sieveline.plans.planner import plan
from sieveline.sources import files
from sieveline.streaming.ingest import stream_documents, stream_labels

ROWS = [(1, 0, "body", "one two three"), (2, 0, "body", "two three four"), (3, 0, "body", "three four five")]


def make(spark, path, rows=ROWS):
    index = Index.create(spark, str(path))
    if rows:
        index.add_entries(spark.createDataFrame(rows, "doc_id long, seq int, field string, text string"))
    return index


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("three") / "index")


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("one two", [1]), ("three five", [3]), ("one five", []), ("three", [3, 2, 1]), ("one one one", [1]),
        ("one OR two", [2, 1]), ("one OR two OR three", [3, 2, 1]), ("three OR two OR one", [3, 2, 1]), ("one OR one OR one", [1]),
        ("six OR one", [1]), ("six OR nine", []), ('"one"', [1]), ('"one two"', [1]), ('"one two three"', [1]), ('"one two three four"', []),
        ('"three four five"', [3]), ('"two three"', [2, 1]), ('"two two"', []), ("two (three OR one)", [2, 1]), ("two (three OR four OR five)", [2, 1]),
        ('"two three" OR four', [3, 2, 1]), ('"two three" one', [1]), ("three -one", [3, 2]), ("*", [3, 2, 1]), ("-*", []),
        ("* OR four", [3, 2, 1]), ("* OR nope", [3, 2, 1]), ("one *", [1]), ("* one", [1]), ("-one", [3, 2]), ("--one", [1]), ("-nope", [3, 2, 1]),
        ("-(one two)", [3, 2]), ("-(one OR two)", [3]), ("", []), ("subject:one", []), ("~none", []), ("-~none", [3, 2, 1]),
    ],
)
def test_queries(three, query, ids):
    assert three.search(query) == ids
    assert three.count(query) == len(ids)


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        (And(), []),
        (And((Term("body", "four"), Term("body", "two"))), [2]),
        (Phrase((Term("body", "two"), Term("body", "one"))), []),
        (And((Phrase((Term("body", "two"), Term("body", "three"))), Term("body", "one"))), [1]),
        (Not((Phrase((Term("body", "one"), Term("body", "three"))),)), [3, 2, 1]),
        (And((Not((Term("body", "one"),)), Term("body", "three"))), [3, 2]),
        (Or(), []),
        (Empty(), []),
        (Every(), [3, 2, 1]),
    ],
)
def test_built_queries(three, query, ids):
    assert three.search(query) == ids


def test_negation_of_nothing(three):
    with pytest.raises(QueryError):
        three.search("-()")


def test_pages(three):
    cursor = three.cursor("three")
    assert [cursor.next(1) for _ in range(5)] == [[3], [2], [1], [], []]
    assert list(three.iter_results("three", 2)) == [3, 2, 1]
    assert three.search("three", 2) == [3, 2]


def test_cursor_keeps_its_documents(spark, tmp_path):
    index = make(spark, tmp_path / "i")
    cursor = index.cursor("-five")
    assert cursor.next(1) == [2]
    index.add_entry(Entry().add_string("body", "new"))
    assert cursor.next(5) == [1] and index.search("-five") == [4, 2, 1]


def test_empty_index(spark, tmp_path):
    index = make(spark, tmp_path / "i", None)
    for query in ("hello", '"four five"', "four OR five", "-hello", "*", "~l"):
        assert index.search(query) == [] and index.count(query) == 0
    assert index.size() == 0
    assert index.stats().first().docs == 0


def test_fields_positions_and_entries(spark, tmp_path):
    index = Index.open(spark, str(tmp_path / "i"))
    assert index.add_entry(Entry().add_string("subject", "greetings there sue").add_string("body", "well sue i am here")) == 1
    assert index.add_entry(Entry().add_string("subject", "greetings holiday").add_string("body", "well dave i am going now").add_token("body", "a b:c")) == 2
    assert index.add_entry(Entry().add_string("body", "split")) == 3
    two = Entry().add_string("body", "first half").add_string("body", "second half")
    assert len(two) == 4 and index.add_entry(two) == 4
    for query, n in [("subject:there", 1), ("body:there", 0), ("there", 0), ("subject:greetings", 2), ("greetings", 0), ("subject:holiday dave", 1), ("subject:holiday -body:dave", 0), ("subject:greetings -dave", 1), ('subject:greetings "i am going"', 1), ('-subject:greetings "i am going"', 0), ('"half second"', 1)]:
        assert index.count(query) == n, query
    assert index.search(Term("body", "a b:c")) == [2]
    with pytest.raises(IndexStateError):
        Index.create(spark, str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.size() == 4
    Index.delete(spark, str(tmp_path / "i"))
    assert not Index.exists(spark, str(tmp_path / "i"))
    with pytest.raises(IndexStateError):
        Index.load(spark, str(tmp_path / "i"))


def test_version(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    index.folder.delete("meta.json")
    index.folder.publish("meta.json", '{"version": 99}')
    with pytest.raises(VersionError):
        Index.load(spark, str(tmp_path / "i"))


def test_labels(spark, tmp_path):
    index = make(spark, tmp_path / "i")
    assert index.search("three ~bob") == []
    index.add_label(1, "bob")
    index.add_label(1, "bob")
    assert index.search("three ~bob") == [1]
    index.add_labels(spark.createDataFrame([("bob", 2), ("potato", 1), ("potato", 2), ("potato", 3)], "label string, doc_id long"))
    assert index.search("~potato -~bob") == [3] and index.search("four ~bob") == [2]
    index.remove_label(2, "bob")
    index.remove_label(2, "bob")
    index.remove_label(99, "nope")
    assert index.search("~bob") == [1] and index.count("~bob") == 1
    index.add_label(2, "bob")
    assert index.search("~bob") == [2, 1]
    index.set_labels(2, {"new", "potato"})
    assert index.search("~bob") == [1] and index.search("~new ~potato") == [2]
    with pytest.raises(IndexStateError):
        index.add_label(99, "bob")


def test_set_semantics_of_disjunctions(spark):
    post = spark.createDataFrame([("body", "a", 5, [0]), ("body", "b", 5, [1]), ("body", "b", 3, [0])], "field string, word string, doc_id long, positions array<int>")
    docs = spark.range(1, 6).toDF("doc_id")
    none = spark.createDataFrame([], "label string, doc_id long")
    ids = lambda q: sorted((r.doc_id for r in plan(parse(q), docs, post, none).collect()), reverse=True)
    assert ids("a OR b") == [5, 3] and ids("-(a OR b)") == [4, 2, 1] and ids("-x") == [5, 4, 3, 2, 1]


def _eval(q, docs, labels, universe):
    sub = lambda c: _eval(c, docs, labels, universe)
    if isinstance(q, Term):
        return {d for d, w in docs.items() if q.word in w}
    if isinstance(q, Label):
        return {d for n, d in labels if n == q.name}
    if isinstance(q, Every):
        return set(universe)
    if isinstance(q, Not):
        return universe - sub(q.children[0])
    if isinstance(q, And):
        return set.intersection(*map(sub, q.children)) if q.children else set()
    if isinstance(q, Or):
        return set().union(*map(sub, q.children))
    if isinstance(q, Phrase):
        words = [t.word for t in q.children]
        return {d for d, w in docs.items() if any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))} if words else set()
    return set()


def test_random_trees(spark):
    rnd = random.Random(3)
    docs = {i: [rnd.choice("abc") for _ in range(rnd.randint(0, 5))] for i in range(12)}
    labels = [(rnd.choice("xy"), i) for i in range(0, 12, 2)]
    post = {}
    for d, words in docs.items():
        for p, w in enumerate(words):
            post.setdefault(("body", w, d), []).append(p)
    P = spark.createDataFrame([(*k, v) for k, v in post.items()], "field string, word string, doc_id long, positions array<int>").coalesce(1).cache()
    D = spark.createDataFrame([(d,) for d in docs], "doc_id long").coalesce(1).cache()
    L = spark.createDataFrame(labels, "label string, doc_id long").coalesce(1).cache()

    def tree(depth):
        kind = rnd.choice(["term", "label", "phrase", "every", "empty"] if depth == 0 else ["and", "or", "not", "term", "phrase"])
        term = lambda: Term("body", rnd.choice("abcd"))
        if kind == "and" or kind == "or":
            return (And if kind == "and" else Or)(tuple(tree(depth - 1) for _ in range(rnd.randint(0, 3))))
        if kind == "not":
            return Not((tree(depth - 1),))
        if kind == "phrase":
            return Phrase(tuple(term() for _ in range(rnd.randint(0, 3))))
        return {"term": term, "label": lambda: Label(rnd.choice("xyz")), "every": Every, "empty": Empty}[kind]()

    for _ in range(40):
        q = tree(3)
        got = [r.doc_id for r in plan(q, D, P, L).collect()]
        assert len(got) == len(set(got)) and set(got) == _eval(q, docs, labels, set(docs)), str(q)


def test_ids_are_given_out_and_batches_merged(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    texts = spark.createDataFrame([(f"word{i % 3} x",) for i in range(20)] + [(None,), ("",)], "t string").repartition(3)
    texts = texts.selectExpr("*", "1 as tokens", "2 as word", "3 as positions")
    assert index.add_documents(texts, {"body": "t"}, ["t", "tokens", "word", "positions"]) == 22
    assert index.add_documents(texts, {"body": "t"}, ["t"]) == 22
    assert sorted(index.search("*")) == list(range(1, 45))
    index.add_label(1, "l")
    before = sorted(index.search("word1 -~l"))
    assert index.optimize() and sorted(index.search("word1 -~l")) == before and index.size() == 44
    assert not index.optimize()
    kept = index.with_columns(index.find("word1"))
    assert {r.t for r in kept.collect()} == {"word1 x"}
    stats = {(r.field, r.word): (r.df, r.occurrences) for r in index.term_stats().collect()}
    assert stats["body", "x"] == (40, 40)
    dump = [(r.field, r.word, r.doc_id) for r in index.dump().collect()]
    assert dump == sorted(dump, key=lambda x: (x[0], x[1], -x[2])) and len(dump) == 80


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, t string").coalesce(1)


def test_two_writers(spark, tmp_path, monkeypatch):
    index = Index.create(spark, str(tmp_path / "i"))
    other = Index.load(spark, index.path)
    publish = index.folder.publish

    def late(name, text):
        if name.startswith("commits/") and not late.done:
            late.done = True
            assert other.add_documents(texts(spark, (7, "beta")), {"body": "t"}) == 1
            other.add_label(7, "l")
        return publish(name, text)

    late.done = False
    monkeypatch.setattr(index.folder, "publish", late)
    assert index.add_documents(texts(spark, (1, "alpha"), (2, "alpha")), {"body": "t"}) == 2
    assert late.done and index.size() == other.size() == 3
    assert other.search("alpha") == [2, 1] and index.search("beta ~l") == [7]
    # the same id from both: the later one is refused, and leaves nothing
    late.done = False
    monkeypatch.setattr(other, "add_label", lambda *a: None)
    with pytest.raises(IndexStateError):
        monkeypatch.setattr(other, "add_documents", lambda *a: Index.load(spark, index.path).add_documents(texts(spark, (9, "gamma")), {"body": "t"}))
        index.add_documents(texts(spark, (8, "delta"), (9, "delta")), {"body": "t"})
    assert index.search("delta") == [] and index.search("gamma") == [9]
    assert len(index.folder.names("docs")) == 3
    # ids that are given out are given once
    a, b = index._reserve(5), other._reserve(3)
    assert b == a + 5


def test_ids_are_checked(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    with pytest.raises(IndexStateError):
        index.add_documents(texts(spark, (1, "a"), (1, "b")), {"body": "t"})
    assert index.add_documents(texts(spark, (1, "a"), (None, "b"), (5, None)), {"body": "t"}) == 2
    with pytest.raises(IndexStateError):
        index.add_documents(texts(spark, (5, "a")), {"body": "t"})
    assert index.add_documents(texts(spark, (3, "a")), {"body": "t"}) == 1 and index.search("a") == [3, 1]


def test_newest_batches_first(spark, tmp_path, monkeypatch):
    index = Index.create(spark, str(tmp_path / "i"))
    for k in range(4):
        index.add_documents(spark.range(k * 10_000, k * 10_000 + 20).selectExpr("id as doc_id", "'w x' as t"), {"body": "t"})
    read = []
    table = index._table
    monkeypatch.setattr(index, "_table", lambda name, schema, commits: read.append(len(commits)) or table(name, schema, commits))
    assert index.search("w", 5) == [30_019, 30_018, 30_017, 30_016, 30_015] and max(read) == 1
    assert index.search("w x -nope", 25)[-1] == 20_015 and index.search("w", 1000)[-1] == 0
    cursor = index.cursor("w")
    assert cursor.next(30)[-1] == 20_010 and cursor.next(100)[-1] == 0 and cursor.next(5) == []


def test_many_commits_are_listed_in_snapshots(spark, tmp_path, monkeypatch):
    from sieveline.operators import index as module

    monkeypatch.setattr(module, "SNAPSHOT", 3)
    index = make(spark, tmp_path / "i")
    for i in (1, 2, 3, 1):
        index.add_label(i, "l")
    index.remove_label(2, "l")
    assert index.folder.names("snapshots") and index.count("~l") == 2
    assert Index.load(spark, index.path).search("~l") == [3, 1]
    assert index.optimize() and index.search("~l") == [3, 1] and index.count("~l") == 2
    assert [tuple(r) for r in index.label_stats().collect()] == [("l", 2)]
    index.add_label(2, "l")
    index.remove_label(1, "l")
    assert index.search("~l") == [3, 2] and Index.load(spark, index.path).count("~l") == 2
    assert len(index.folder.names("labels")) == 3


def test_label_streams_are_applied_once(spark, tmp_path):
    index = make(spark, tmp_path / "i")
    ops = lambda *rows: spark.createDataFrame(list(rows), "op string, label string, doc_id long")
    index.apply_labels(ops(("add", "l", 1), ("add", "m", 1), ("remove", "m", 1), ("nope", "l", 2)), "labels/0")
    assert index.search("~l") == [1] and index.search("~m") == []
    index.remove_label(1, "l")
    index.apply_labels(ops(("add", "l", 1)), "labels/0")
    assert index.search("~l") == []
    with pytest.raises(IndexStateError):
        index.apply_labels(ops(("add", "l", 99)), "labels/1")
    assert index.search("~l") == []


def test_postings_of_texts_equal_those_of_expressions(spark):
    from sieveline.operators import postings as post

    rows = spark.createDataFrame([(1, "a b a -5 x_y", "b a"), (2, None, "é a<b " + "w" * 51 + " z"), (3, "", None), (4, "漢字 1.2.3 a. " * 50, "a")], "doc_id long, t string, u string")
    fields = {"f": "t", "g": "u"}
    old = post.build(rows.select("doc_id", post.field_tokens(fields).alias("tokens")))
    got = sorted(map(tuple, post.of_texts(rows, fields).collect()))
    assert got == sorted(map(tuple, old.collect())) and got
    assert post.of_texts(rows, {}).count() == 0


def test_clustering_reaches_the_scan(spark, three):
    text = three.find("one two")._jdf.queryExecution().toString()
    assert "PushedFilters" in text and text.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello a")
    (tmp_path / "b.txt").write_text("hello b\nmore")
    index = Index.create(spark, str(tmp_path / "files"))
    assert files.index_text_files(index, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]) == 2
    assert index.search("hello") == [2, 1] and index.search('"b more"') == [2]
    (tmp_path / "box").write_text("From a@b Mon\nSubject: Hi\n\nFirst MAIL\nFrom c@d Tue\nsecond mail\n")
    index = Index.create(spark, str(tmp_path / "mails"))
    assert files.index_mbox(index, str(tmp_path / "box")) == 2
    assert index.search("mail ~inbox") == [2, 1] and index.search("first") == [1] and index.search("Mon") == []
    assert all(r.query for r in files.random_queries(index.docs(), share=1.0).collect())


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "red"), (2, "red blue")], "doc_id long, t string").coalesce(1).write.parquet(str(source))
    index = Index.create(spark, str(tmp_path / "i"))
    rows = spark.readStream.schema("doc_id long, t string").parquet(str(source))
    stream_documents(index, rows, {"body": "t"}, str(tmp_path / "ck")).awaitTermination()
    assert index.search("red") == [2, 1]
    spark.createDataFrame([(3, "red")], "doc_id long, t string").write.mode("append").parquet(str(source))
    stream_documents(index, rows, {"body": "t"}, str(tmp_path / "ck")).awaitTermination()
    assert index.search("red") == [3, 2, 1]
    assert index.add_documents(spark.createDataFrame([(9, "red")], "doc_id long, t string"), {"body": "t"}, source="documents/0") == 0
    spark.createDataFrame([(1, "add", "l", 1), (2, "remove", "l", 1), (1, "add", "l", 2)], "seq long, op string, label string, doc_id long").write.parquet(str(tmp_path / "ops"))
    ops = spark.readStream.schema(label_ops.LOG).parquet(str(tmp_path / "ops"))
    stream_labels(index, ops, str(tmp_path / "ck2")).awaitTermination()
    assert index.search("~l") == [2]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the quick fox")
    path = str(tmp_path / "i")

    def run(*args, lines=()):
        out = io.StringIO()
        code = cli.main(list(args), spark, out, lines)
        return code, out.getvalue()

    assert run("index-files", path, str(tmp_path / "a.txt"))[1].startswith("added 1 documents")
    assert "| the quick fox" in run("search", path, "quick")[1]
    assert "found 1 results" in run("count", path, lines=["fox", "(", "-()"])[1]
    assert "found doc 1" in run("interactive", path, lines=["fox"])[1]
    assert "body:fox @1 [2]" in run("dump", path)[1]
    assert "docs: 1" in run("info", path)[1]
    (tmp_path / "q").write_text("fox\nthe\n")
    assert run("benchmark", path, str(tmp_path / "q"))[1].splitlines()[-1].startswith("2 queries")
    assert run("nope", path)[0] == 2
    assert run("make-queries", path)[0] == 0


def test_postings_are_ordered_from_file_to_file(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from sieveline.operators import postings as post

    monkeypatch.setattr(post, "TASK_BYTES", 1 << 10)
    ids = [(i * 7919) % 3001 + (i % 3) * 70_000 - 1000 for i in range(3000)]  # in no order, over several spans
    rows = spark.createDataFrame([(d, f"the w{d % 7} x{k} the") for k, d in enumerate(ids)], "doc_id long, t string").repartition(3)
    index = Index.create(spark, str(tmp_path / "i"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert index.add_documents(rows, {"body": "t"}) == 3000
    batch = index.folder.names("postings")[0]
    names = [n for n in index.folder.names(f"postings/{batch}") if n.endswith(".parquet")]
    assert len(names) > int(before)  # tasks follow the input, not the session
    found = [r for n in names for r in pq.read_table(f"{tmp_path}/i/postings/{batch}/{n}").to_pylist()]
    key = [(r["field"], r["word"], -r["doc_id"]) for r in found]
    assert key == sorted(key) and len(set(key)) == 9000
    assert all(r["positions"] == {"t": [0, 3], "w": [1], "x": [2]}[r["word"][0]] for r in found)
    stats = {r.word: (r.df, r.occurrences) for r in index.term_stats().collect()}
    assert stats["the"] == (3000, 6000) and sum(n for n, _ in stats.values()) == 9000
    dump = index.dump()
    assert "Exchange" not in dump._jdf.queryExecution().executedPlan().toString()  # the files are in order
    assert [(r.field, r.word, -r.doc_id) for r in dump.collect()] == key


def test_random_queries_move_nothing(spark):
    docs = spark.createDataFrame([(f"a{i} b{i}, {'w' * 60} c{i}",) for i in range(50)] + [(None,), ("",)], "body string").coalesce(1)
    every = ["w" * 60 if k == 2 else f"{'abxc'[k]}{i}" for i in range(50) for k in range(4)]
    found = files.random_queries(docs, share=1.0, words=3)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert [r.query for r in found.collect()] == [" ".join(every[i : i + 3]) for i in range(0, 200, 3)]
    some = files.random_queries(docs, share=0.3, words=1, seed=5)
    picked = [r.query for r in some.collect()]
    assert 20 < len(picked) < 120 and set(picked) <= set(every) and picked == [r.query for r in some.collect()]


def test_the_rest_of_a_cursor(spark, tmp_path, monkeypatch):
    from sieveline.operators import index as module

    monkeypatch.setattr(module, "PLACE_BITS", 3)
    index = Index.create(spark, str(tmp_path / "i"))
    for k in (0, 1):
        index.add_documents(spark.range(k * 100 - 20, k * 100 + 20).selectExpr("id as doc_id", "if(id % 3 = 0, 'w x', 'w') as t"), {"body": "t"})
    left = [i for i in [*range(119, 79, -1), *range(19, -21, -1)] if i % 3]
    cursor, started = index.cursor("w -x"), index.cursor("w -x")
    assert started.next(5) == left[:5]
    jobs = []
    monkeypatch.setattr(index, "_newest", lambda *a: jobs.append(a))
    index.add_entry(Entry().add_string("body", "w"))  # comes later than both cursors
    places = lambda c: sorted(map(tuple, c.rest().collect()))
    assert places(cursor) == list(enumerate(left)) and places(started) == list(enumerate(left[5:]))
    assert not jobs and cursor.next(5) == [] and places(cursor) == []
