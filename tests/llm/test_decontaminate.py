import random
import re

import pytest

from sieveline.llm import decontaminate as dc


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def brute_runs(tokens, items, length, coverage, least):
    """Covered words by trying every window of every length against every item."""
    gone = [False] * len(tokens)
    longest = 0
    items = [x for x in items if len(x) >= least]
    for a in range(len(tokens)):
        for b in range(a + 1, len(tokens) + 1):
            inside = [len(x) for x in items if any(x[i : i + b - a] == tokens[a:b] for i in range(len(x)))]
            if not inside:
                break
            longest = max(longest, b - a)
            if b - a >= length or b - a >= least and b - a >= coverage * min(inside) - 1e-9:
                gone[a:b] = [True] * (b - a)
    return gone, longest


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        items = [[rnd.randint(0, 3) for _ in range(rnd.randint(0, 12))] for _ in range(rnd.randint(0, 4))]
        length, coverage, least = rnd.randint(2, 8), rnd.choice([0.3, 0.6, 1.0]), rnd.randint(1, 4)
        a = dc.Automaton(items, length, coverage, least)
        tokens = [rnd.randint(0, 4) for _ in range(40)]
        spans, longest = a.stream(tokens)
        gone = [False] * 40
        for x, y in dc.merged(spans):
            gone[x:y] = [True] * (y - x)
        assert (gone, longest) == brute_runs(tokens, items, length, coverage, least)


def make(seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.choice([3, 6, 9, 20, 40])) for _ in range(15)]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 60))
        for _ in range(rnd.randint(1, 3)):
            item = rnd.choice(items)
            a = rnd.randint(0, len(item) - 1)
            at = rnd.randint(0, len(t))
            t[at:at] = item[a : a + rnd.randint(1, len(item))]
        docs.append((i, " ".join(t)))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)]


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in dc.decontaminate(d, b, **more).collect()}


@pytest.mark.parametrize("tokens", [dc.TOKENS, 30])
def test_table_against_brute_force(spark, tokens):
    docs, items = make(1)
    got = run(spark, docs, items, tokens=tokens)
    cut = 0
    for i, text in docs:
        gone, longest = brute_runs(words(text), [words(x) for _, x in items], dc.LENGTH, dc.COVERAGE, dc.LEAST)
        kept = [w for w, g in zip(words(text), gone, strict=True) if not g]
        assert words(got[i].text) == kept and got[i].removed_words == sum(gone), i
        if sum(gone):
            assert got[i].longest_match == longest
        else:
            assert got[i].text == text
        cut += bool(sum(gone))
    assert 10 < cut < 60


@pytest.mark.parametrize("tokens", [dc.TOKENS, 30])
def test_longest_match_of_all_rows(spark, tokens):
    docs, items = make(2)
    short = [(100 + i, " ".join(words(text)[:i])) for i, (_, text) in enumerate(items)] + [(200, "none of these"), (201, "")]
    for benchmark in (items, [x for x in items if len(words(x[1])) >= 20]):
        got = run(spark, docs + short, benchmark, tokens=tokens)
        want = {i: brute_runs(words(text), [words(x) for _, x in benchmark], dc.LENGTH, dc.COVERAGE, dc.LEAST)[1] for i, text in docs + short}
        assert {i: r.longest_match for i, r in got.items()} == want
        assert want[200] == 0 and set(range(1, 5)) <= set(want.values())


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "a b"), (4, "One two, three four five six seven!"), (4, "One two, three four five six seven!"), (None, "9 8 7 6 5 4 3 2 1 0 11 12")]
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "Hello: ONE two three — four five six seven! Bye.", 48), (4, "one two three four five six seven", 33), (None, "9 8 7 6 5 4 3 2 1 0 x", 1), (5, "x " * 300_000 + "one two three four five six seven", 1), (6, "a b c", 5)],
        "doc_id long, text string, n_chars long",
    ).selectExpr("*", "'k' as removed_words", "7 as longest_match", "'c' as c0")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.decontaminate(docs, benchmark)
    assert got.columns == ["doc_id", "text", "n_chars", "c0", "removed_words", "longest_match"]
    r = {x.doc_id: x for x in got.collect()}
    assert r[1].text is None and r[2].text == "" and r[3].text == "Hello: Bye." and r[3].n_chars == 11 and r[4].text == "" and r[6].text == "a b c"
    assert words(r[None].text) == ["x"] and words(r[5].text) == ["x"] * 300_000
    assert dc.decontaminate(docs, benchmark.limit(0)).filter("removed_words > 0").count() == 0
    assert dc.decontaminate(docs.limit(0), benchmark).count() == 0
