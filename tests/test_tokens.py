import random

import pytest

from sieveline.functions import tokens as T
from sieveline.functions.snippets import excerpt, snippet_spans, snippets
from sieveline.plans.parser import parse

CASES = [
    ("we love cats", ["we", "love", "cats"]),
    ("hey! so: you're <cool>", ["hey", "so", "you're", "cool"]),
    ("in 2001. ok", ["in", "2001.", "ok"]),
    ("-5abc", ["-5", "abc"]),
    ("1,000 U.S. foo_bar _x_ 3.14. 1.2.3 12.)", ["1,000", "U.S", "foo_bar", "x", "3.14", "1.2.3", "12."]),
    ("", []),
    (" \t\r\n.,;", []),
    ("a—b 我 。", ["a—b", "我", "。"]),
    ("foo,bar a<b>c", ["foo,bar", "a", "b", "c"]),
]


@pytest.mark.parametrize(("text", "words"), CASES)
def test_local(text, words):
    assert T.local_tokens(text) == words


def test_spark_agrees(spark):
    rnd = random.Random(5)
    texts = [t for t, _ in CASES] + ["".join(rnd.choice("ab01-.,'<> _é我\n\t!") for _ in range(40)) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.tokens("t").alias("w")).collect():
        assert r.w == T.local_tokens(texts[r.i]), texts[r.i]


def _longest_match(text: str) -> list[str]:
    """A lexer by longest match over the rules, character by character."""
    import re

    blank, punct = " \t\r\n", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    ends = lambda c: c not in blank and c not in punct
    out, at = [], 0
    while at < len(text):
        best = 0
        if m := re.compile(r"-?[0-9]+(\.[0-9]*)?").match(text, at):
            best = len(m[0])
        if ends(text[at]):
            stop = at + 1
            for i in range(at + 1, len(text)):
                if text[i] in blank:
                    break
                if ends(text[i]):
                    stop = i + 1
                if text[i] in "<>":
                    break
            best = max(best, stop - at)
        if best:
            out.append(text[at : at + best])
        at += best or 1
    return out


def test_against_longest_match():
    rnd = random.Random(6)
    for _ in range(20000):
        text = "".join(rnd.choice("ab01-.,< é\n") for _ in range(rnd.randint(0, 12)))
        assert T.local_tokens(text) == _longest_match(text), repr(text)


def test_long_tokens_take_no_position(spark):
    text = f"{'x' * 50} {'y' * 51} {'é' * 26} z"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(T.index_tokens("t")).collect()] == [["x" * 50, "z"], []]


def test_ascii_lower(spark):
    assert spark.createDataFrame([("AbÉ",)], "t string").select(T.ascii_lower("t")).first()[0] == "abÉ"


TEXT = "birds sing, they do — and we sing: birds of the air, the birds."


@pytest.mark.parametrize("query", ["", "-birds", "*", "~birds", "other:birds", "zzz"])
def test_no_snippets(query):
    assert snippet_spans(parse(query), "body", TEXT) == []


@pytest.mark.parametrize(
    ("query", "words"),
    [
        ("sing", ["sing", "sing"]),
        ("sing birds", ["birds", "sing", "sing", "birds", "birds"]),
        ("sing OR birds", ["birds", "sing", "sing", "birds", "birds"]),
        ('"birds of the"', ["birds of the"]),
        ('"the birds of"', []),
        ("air -sing", ["air"]),
        ('"the birds" OR the', ["the", "the birds"]),
    ],
)
def test_snippets(query, words):
    raw = TEXT.encode()
    assert [raw[a:b].decode() for a, b in snippet_spans(parse(query), "body", TEXT)] == words


def test_snippet_limit_and_excerpt():
    spans = snippet_spans(parse("birds"), "body", TEXT, 2)
    assert len(spans) == 2 and excerpt(TEXT, spans[1], 4) == "ng: birds of "


def test_snippet_column(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, t string")
    got = {r.id: [(s.start, s.end) for s in r.s] for r in df.select("id", snippets(parse("sing"), "body", "t").alias("s")).collect()}
    assert got == {1: snippet_spans(parse("sing"), "body", TEXT), 2: [], 3: []}


def test_snippets_of_a_long_text_hold_a_window_of_it():
    import tracemalloc

    text = b"the x y " * 100_000
    tracemalloc.start()
    first = snippet_spans(parse('"y the" OR nope'), "body", text, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first == [(6, 11), (14, 19), (22, 27)] and peak < 4 << 20
    assert len(snippet_spans(parse('"y the"'), "body", text, None)) == 99_999  # across windows, too
