import pytest

from sieveline.plans.ast import And, Empty, Every, Label, Not, Or, Phrase, QueryError, Term, downcase
from sieveline.plans.parser import ParseError, lex, parse
from sieveline.plans.planner import check, holds_without_leaves, simplify


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("", "<EMPTY>"),
        ("  \t\n", "<EMPTY>"),
        ("()", "<EMPTY>"),
        ("() a", 'body:"a"'),
        ("a ()", 'body:"a"'),
        ("a b c", '(AND body:"a" body:"b" body:"c")'),
        ("(a b) c", '(AND body:"a" body:"b" body:"c")'),
        ("a (b c)", '(AND body:"a" (AND body:"b" body:"c"))'),
        ("a b OR c", '(AND body:"a" (OR body:"b" body:"c"))'),
        ("a OR b OR c", '(OR body:"a" body:"b" body:"c")'),
        ("(a OR b) OR c", '(OR (OR body:"a" body:"b") body:"c")'),
        ('x y OR "p q" f:z', '(AND body:"x" (OR body:"y" (PHRASE body:"p" body:"q")) f:"z")'),
        ("f:(g:a b)", '(AND f:"a" f:"b")'),
        ("f:(a ~l)", '(AND f:"a" ~l)'),
        ('f:"a b"', '(PHRASE f:"a" f:"b")'),
        ('"a"', '(PHRASE body:"a")'),
        ("- a", '(NOT body:"a")'),
        ("--a", '(NOT (NOT body:"a"))'),
        ("a : b", 'a:"b"'),
        ("~ l", "~l"),
        ("*", "<EVERY>"),
        ("* a", '(AND <EVERY> body:"a")'),
        ("ruby-talk a~b c*d", '(AND body:"ruby-talk" body:"a~b" body:"c*d")'),
        ("ORDER or", '(AND body:"ORDER" body:"or")'),
        ("foo,", 'body:"foo,"'),
        ("吞下 身體", '(AND body:"吞下" body:"身體")'),
    ],
)
def test_rendering(text, shown):
    assert str(parse(text)) == shown


@pytest.mark.parametrize("text", ["OR a", "a OR", '""', "a:b:c", "a:-b", "a:~b", "a:*", "(a", "a)", '"a', '"a OR b"', '"-a"', "-", "~", "a:", "~(a)", "~*", ":a", '"a (b)"'])
def test_errors(text):
    with pytest.raises(ParseError, match="parse error: line 1"):
        parse(text)


def test_error_names_the_line():
    with pytest.raises(ParseError, match="line 3"):
        parse("a\nb\n OR")


def test_default_field_and_structure():
    q = parse("i like cheese", "subject")
    assert isinstance(q, And) and q.children == tuple(Term("subject", w) for w in ("i", "like", "cheese"))


def test_map_terms_leaves_labels_and_nones():
    q = parse("i like ~cheese f:x")
    assert str(q.map_terms(lambda field, word: f"<{word}>" if field == "body" else None)) == '(AND body:"<i>" body:"<like>" ~cheese f:"x")'
    assert str(q) == '(AND body:"i" body:"like" ~cheese f:"x")'


def test_combinators_do_not_flatten():
    a, b = parse("x y"), parse("z")
    assert str(a & b) == '(AND (AND body:"x" body:"y") body:"z")'
    assert str(a | b) == '(OR (AND body:"x" body:"y") body:"z")'
    assert (a & Empty()) == And((a,))


def test_add_drops_empty_queries():
    assert Or().add(Empty()) == Or() and Empty().add(Term("f", "a")) == Term("f", "a")
    with pytest.raises(QueryError):
        Term("f", "a").add(Term("f", "b"))


def test_negation_takes_one_child():
    for bad in (Not(), Not((Every(), Every())), parse("-()")):
        with pytest.raises(QueryError):
            check(bad)


def test_phrases_are_made_of_terms():
    with pytest.raises(QueryError):
        check(Phrase((Label("x"),)))


def test_simplify():
    a, b = Term("f", "a"), Term("f", "b")
    assert simplify(And((a, a, Every()))) == a
    assert simplify(And((a, Empty()))) == Empty()
    assert simplify(Or((a, Empty(), a))) == a
    assert simplify(Or((a, Every()))) == Every()
    assert simplify(Not((Not((a,)),))) == a
    assert simplify(Not((Empty(),))) == Every()
    assert simplify(And()) == Empty()
    assert simplify(Phrase((a,))) == a
    assert simplify(Or((a, b))) == Or((a, b))


@pytest.mark.parametrize(("text", "holds"), [("-a", True), ("a", False), ("a OR -b", True), ("a -b", False), ("--a", False), ("-(a OR b)", True), ("*", True), ('"a b"', False)])
def test_universe_is_needed(text, holds):
    assert holds_without_leaves(parse(text)) is holds


def test_downcase_keeps_or():
    assert downcase('From:Bob OR "The Man" -X') == 'from:bob OR "the man" -x'


def test_lex_places():
    assert lex("a OR ~b") == [("WORD", "a", 0), ("OR", "OR", 2), ("~", "~", 5), ("WORD", "b", 6)]
