import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import ngram_join, textvec


def words(text):
    import re

    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def grams(text, n=2):
    w = words(text or "")
    return {" ".join(w)} if 0 < len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, t, n=2):
    sets = [(d, grams(x, n)) for d, x in rows if d is not None]
    best = {}
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y:
            j = len(x & y) / len(x | y)
            if j >= t - 1e-12:
                key = (min(a, b), max(a, b))
                best[key] = max(best.get(key, 0), j)
    return best


def make(seed, count=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(count):
        if rows and rnd.random() < 0.6:
            text = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 8, 20, 60, 300])))))
    return rows


def run(spark, rows, t=ngram_join.THRESHOLD, n=2):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_pairs(df, t, n).collect()
    found = {(r.doc_a, r.doc_b): r.jaccard for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize(("seed", "t", "n"), [(1, 0.6, 2), (2, 0.3, 2), (3, 0.9, 3), (4, 1.0, 2)])
def test_against_brute_force(spark, seed, t, n):
    rows = make(seed)
    got, want = run(spark, rows, t, n), brute(rows, t, n)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a"), (5, "A!"), (6, "a b"), (7, "a b c d e f"), (7, "a b c d e f g"), (8, "a b c d e f"), (8, "a b c d e f"), (None, "a b c d e f"), (9, "x " * 50_000)]
    assert run(spark, rows) == pytest.approx(brute(rows, 0.6))


def classes(rows, t):
    """(class, links) of each doc_id, by brute force."""
    ids = {d for d, _ in rows if d is not None}
    near = {d: set() for d in ids}
    for a, b in brute(rows, t):
        near[a].add(b)
        near[b].add(a)
    out = {}
    for d in sorted(ids):
        if d not in out:
            seen, todo = {d}, [d]
            while todo:
                todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
            out |= {x: (d, len(near[x])) for x in seen}
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_classes(spark, seed):
    rows = make(seed)
    rows += [(100 + i, rows[i][1]) for i in range(30)] + [(200, rows[3][1]), (200, rows[4][1]), (200, rows[3][1] + " more"), (201, None), (202, ""), (None, rows[3][1]), (203, "x " * 50_000), (3, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as links", "'a' as sid")
    got = ngram_join.classes(df).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == classes(rows, 0.6) and len(got) == len({r.doc_id for r in got})
    assert ngram_join.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_keys_are_cut(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = make(11, 70) + [(500 + i, f"a b c d e f g h x{i}") for i in range(30)]
    for light in (0, 40):
        monkeypatch.setattr(ngram_join, "boundary", lambda *a, light=light: light)
        assert run(spark, rows) == pytest.approx(brute(rows, 0.6))


def test_classes_agree_with_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from sieveline.llm import queries

    rows = make(12, 80) + [(300, None), (301, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["op1_ngram_jaccard_join"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op1_ngram_jaccard_join"](spark, str(tmp_path)).collect())) == want


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, sid string, key string")
    assert ngram_join.jaccard_pairs(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c", 5, "k", 1), (2, "a b c", 6, "k", 1)], "doc_id int, text string, sid long, a string, jaccard int")
    assert [tuple(r) for r in ngram_join.jaccard_pairs(df).collect()] == [(1, 2, 1.0)]
    with pytest.raises(ValueError):
        ngram_join.jaccard_pairs(df, 0)


def test_heavy_and_light_sets(spark, monkeypatch):
    rows = make(9, 80)
    want = brute(rows, 0.6)
    for light in (0, 40):
        monkeypatch.setattr(ngram_join, "boundary", lambda *a, light=light: light)
        assert run(spark, rows).keys() == want.keys()


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_PAIRS", 20)
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t x{i}") for i in range(25)]
    assert len(run(spark, rows)) == 300


def test_groups_keep_the_smallest(spark):
    base = "a b c d e f g h i j k l m n o p"
    rows = [(5, base), (3, base + " q"), (9, base + " q r"), (7, "z y x w v"), (2, None), (None, base), (4, "z y x w v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lost_id2", "'s' as source")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", base + " q"), ("2", None), ("None", base), ("4", "z y x w v")])


def test_chains_are_one_group(spark):
    w = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(w[i * 2 : i * 2 + 40])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.one_of_each(df).collect()] == [0]


def test_boundary_is_by_cost():
    assert ngram_join.boundary({}, 0.6, 1.0) == 0
    assert ngram_join.boundary({5: 1000}, 0.6, 1e9) >= 5
    assert ngram_join.boundary({400: 1000}, 0.6, 0.0) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 .é—漢\xa0İ×", max_size=12)), max_size=6))
def test_words(texts):
    import pyarrow as pa
    import re

    w = textvec.words(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for i, a, b in zip(w.doc, w.start, w.end, strict=True):
        got[i].append(bytes(w.buf[a:b]).decode())
    separators = r"[^\x00-/:-@\[-`{-\x7f\xa0-\xbf\xd7\xf7 -ⁿ　-〿]+"
    assert got == [re.findall(separators, "".join(map(textvec._fold_char, t or ""))) for t in texts]
    assert len(set(map(int, w.hash))) == len({x for g in got for x in g})


def family(rnd, start, base, count, edits):
    """Near copies of a text, each with up to so many words changed."""
    rows = []
    for i in range(count):
        text = base.split(" ")
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(len(text))] = f"n{rnd.randrange(10**6)}"
        rows.append((start + i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("long", "seed"), [(3, 21), (12, 22), (12, 23)])
def test_cores_of_near_copies(spark, monkeypatch, long, seed):
    monkeypatch.setattr(ngram_join, "LONG", long)
    rnd = random.Random(seed)
    base = " ".join(f"b{i}" for i in range(60))
    other = " ".join(base.split(" ")[:44] + [f"c{i}" for i in range(16)])
    rows = make(seed, 40) + family(rnd, 100, base, 50, 14) + family(rnd, 200, other, 40, 12) + family(rnd, 300, "k l m n o p q r s t u v w", 30, 3)
    rows += [(400 + i, rows[45 + i % 3][1]) for i in range(12)]
    if seed == 22:  # documents of several texts
        rows += [(101, rows[60][1]), (102, rows[95][1]), (500, base), (500, other), (500, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows, 0.6)
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.classes(df).collect()} == want
    assert {r.doc_id for r in ngram_join.one_of_each(df).select("doc_id").collect()} == {c for c, _ in want.values()}


def test_pairs_of_near_copies_are_not_listed(spark, monkeypatch):
    saved = {}
    save = ngram_join.scratch.save
    monkeypatch.setattr(ngram_join.scratch, "save", lambda df, name: saved.setdefault(name, save(df, name)) if name == "ngram-candidates" else save(df, name))
    base = " ".join(f"b{i}" for i in range(80))
    rows = family(random.Random(31), 0, base, 400, 6)
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == classes(rows, 0.6)
    distinct = len({text for _, text in rows})
    listed = saved["ngram-candidates"].selectExpr("coalesce(sum(size(b)), 0) AS k").collect()[0].k
    assert listed < distinct * (distinct - 1) // 2 // 3
