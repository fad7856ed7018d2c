import random
import re

import pytest

from sieveline.llm import html_extract as he


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(rows, depth, min_pages):
    """Kept words of each row, by comparing all windows of a host."""
    host = lambda u: (re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "") or [None, ""])[1].lower()
    pages = {}
    for page, url, html in rows:
        w = words(he.visible(html))
        for i in range(len(w) - depth + 1):
            pages.setdefault((host(url), tuple(w[i : i + depth])), set()).add(page)
    out = []
    for page, url, html in rows:
        w = words(he.visible(html))
        gone = [False] * len(w)
        for i in range(len(w) - depth + 1):
            if len(pages[host(url), tuple(w[i : i + depth])]) >= min_pages:
                gone[i : i + depth] = [True] * depth
        out.append((str(page), [x for x, g in zip(w, gone, strict=True) if not g], sum(gone)))
    return sorted(out)


def make(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))
    rows = []
    for h in range(4):
        menu, foot = text(12), text(9)
        for p in range(12):
            body = "".join(f"<p>{text(rnd.randint(1, 25))}.</p>" for _ in range(rnd.randint(0, 4)))
            rows.append((h * 100 + p, f"https://h{h}.example/p{p}", f"<html><head><title>t</title><script>var x;</script></head><body><nav>{menu}</nav>{body}<footer>{foot} &amp; more</footer></body></html>"))
    return rows


@pytest.mark.parametrize("host_bytes", [he.HOST_BYTES, 0])
@pytest.mark.parametrize(("depth", "min_pages"), [(8, 2), (5, 3)])
def test_against_brute_force(spark, host_bytes, depth, min_pages):
    rows = make(depth)
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (900, None, "<p>" + "lone words here that nobody else has said before</p>"), (None, "bad url", "<p>x</p>"), (901, "http://a@H1.example:80/x", rows[14][2]), (902, "http://e.example", None), (903, "http://e.example", ""), (904, "http://e.example", "<p>" + "z y " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as version")
    got = he.extract(df, depth, min_pages, host_bytes).collect()
    assert sorted((str(r.page_id), words(r.text), r.removed_words) for r in got) == brute(rows, depth, min_pages)
    by = {r.page_id: r for r in got}
    assert by[902].text is None and by[903].text == "" and by[901].host == "h1.example" and by[None].host == ""


def test_kept_runs_have_their_punctuation(spark):
    menu = "home about news sport money travel weather contact"
    rows = [(i, "http://h/x", f"<div>{menu}</div><p>Nr{i} says: hello, world!</p>") for i in range(3)]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"Nr{i} says: hello, world!" for i in range(3)]


def test_visible():
    page = "<!doctype html><!-- no --><style>p{}</style><p>a<b>b</b> &lt;c&gt;</p><p title='>'>d</p><script>x"
    assert he.visible(page) == "ab <c>\nd" and he.visible(None) is None
    assert he.visible("a <br/> b") == "a\nb"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>before</p><svg class="i"/><p>all the text</p>', "before\nall the text"),
        ("<svg><p>kept", "kept"), ("a<noscript>b<p>c", "a\nb\nc"), ("<svg>x</svg>y<TITLE>t</Title >z", "y z"),
        ("<a title=it's>x</a> y", "x y"), ("<a title='a>b' k=\"<\">x</a>", "x"), ("1 < 2 <3 > 2 <b", "1 < 2 <3 > 2 <b"), ("<a x=1 <b>y</b>", "<a x=1 y"),
        ("a<!-- no", "a"), ("a<!doctype", "a"), ("<script>x", ""), ("<a href=\"x>y</a>", "y"), ("<p", "<p"), ("</p >x</", "x</"),
    ],
)
def test_odd_markup(page, text):
    assert he.visible(page) == text


@pytest.mark.parametrize("piece", ["<a x=1 ", '<a x="', "<a x='", "<svg>", "<!--", "<", "<title><svg x=\"'", "</script", "<a x=\"<b y='", "& ", "= ' "])
def test_scanning_is_linear(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    he.visible(page)
    assert time.perf_counter() - began < 8


def test_ranks():
    import numpy as np

    rnd = random.Random(5)
    words = [rnd.randint(0, 2) for _ in range(300)]
    for depth in (1, 2, 3, 5, 8, 11):
        keys = [words[i : i + depth] for i in range(300)]
        order = {tuple(k): r for r, k in enumerate(sorted(set(map(tuple, keys))))}
        assert he.ranks(np.array(words), depth).tolist() == [order[tuple(k)] for k in keys]
    assert len(he.ranks(np.zeros(0, np.int64), 4)) == 0


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert he.extract(df).count() == 0
