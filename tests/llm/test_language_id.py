import random

import numpy as np
import pyarrow as pa

from sieveline.llm import language_id as li
from sieveline.llm import textvec

EN = "the house of my friend is near the river and we often walk there with the children when the weather is good".split()
DE = "das haus von meinem freund ist nahe am fluss und wir gehen dort oft mit den kindern wenn das wetter gut ist".split()
FR = "la maison de mon ami est près de la rivière et nous y marchons souvent avec les enfants quand il fait beau".split()
RU = "дом моего друга рядом с рекой и мы часто гуляем там с детьми когда хорошая погода".split()
SOURCES = {"en": EN, "de": DE, "fr": FR}


def text(rnd, lang, n):
    return " ".join(rnd.choice(SOURCES[lang]) for _ in range(n))


def model(rnd):
    return li.train([(lang, text(rnd, lang, 400)) for lang in SOURCES for _ in range(3)])


def viterbi_brute(s, switch):
    """Best score over all label sequences, by exhaustive recursion on short inputs."""
    n, k = s.shape
    best, path = -np.inf, None
    for code in range(k**n):
        y = [(code // k**i) % k for i in range(n)]
        v = sum(s[i, y[i]] for i in range(n)) - switch * sum(a != b for a, b in zip(y, y[1:], strict=False))
        if v > best + 1e-9:
            best, path = v, y
    return best, path


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 7, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        s = rng.normal(size=(first[-1], 3)).astype(np.float32) * 3
        switch = float(rng.uniform(0.5, 4))
        got = li.viterbi(s, first, np.arange(4), switch)
        single = li.one_language(s, first, switch)
        for i in range(4):
            part = s[first[i] : first[i + 1]].astype(np.float64)
            best, _ = viterbi_brute(part, switch)
            y = got[i]
            value = part[np.arange(len(y)), y].sum() - switch * (np.diff(y) != 0).sum()
            assert abs(value - best) < 1e-5
            if single[i] >= 0:
                assert abs(part[:, single[i]].sum() - best) < 1e-5


def test_spans_of_mixed_text(spark):
    rnd = random.Random(4)
    shared = model(rnd)
    rows = [(1, text(rnd, "en", 60)), (2, text(rnd, "de", 50) + ". " + text(rnd, "fr", 30)), (3, " ".join(RU)), (4, None), (5, " ... "), (6, "12345 678"), (None, text(rnd, "fr", 20)), (7, "日本語 です"), (8, text(rnd, "en", 100_000)), (1, text(rnd, "en", 10))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'xx' as lang", "1 as keep")
    got = li.identify(df, shared).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and {r.lang for r in by[1]} == {"en"} and by[None][0].lang == "fr" and by[8][0].lang == "en"
    mixed = by[2][0]
    assert mixed.lang == "de" and [s.lang for s in mixed.spans] == ["de", "fr"] and abs(mixed.spans[0].end - 50) <= 2 and mixed.spans[1].end == 80
    assert by[3][0].lang == "ru" and by[4][0].lang == by[5][0].lang == "und" and not by[4][0].keep and by[4][0].spans == []
    kept = li.kept(df, shared)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)


def test_fit_and_held_out_accuracy(spark):
    rnd = random.Random(5)
    rows = [(i, text(rnd, lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    train = spark.createDataFrame(rows + [(None, "x", "en"), (500, None, "en"), (501, "x", None)], "doc_id long, text string, lang string")
    m = li.fit(train, 20)
    held = [(i, text(rnd, lang, 15), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    got = {r.doc_id: r.lang for r in li.identify(spark.createDataFrame(held, "doc_id long, text string, l string"), m).collect()}
    assert sum(got[i] == lang for i, _, lang in held) / len(held) > 0.97
    nothing = li.fit(train.limit(0))
    assert {r.lang for r in li.identify(spark.createDataFrame([(1, "hello"), (2, "привет")], "doc_id long, text string"), nothing).collect()} == {"und", "ru"}
    assert li.identify(train.limit(0), m).count() == 0


def test_scripts():
    w = textvec.words(pa.array(["abc ёж 12 3кг 漢字 שלום é"]), hashed=False)
    assert [li.NAMES[s] if s < len(li.NAMES) else "any" for s in li.word_scripts(w)] == ["latin", "cyrillic", "any", "cyrillic", "han", "hebrew", "latin"]


def test_memory_follows_slices():
    """A batch of many texts takes no more than a slice of it at a time."""
    import tracemalloc

    rnd = random.Random(4)
    shared = type("Shared", (), {"value": model(rnd)})
    texts = [text(rnd, rnd.choice(list(SOURCES)), 500) for _ in range(40)] * 100
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    assert rows.nbytes > 4 * textvec.SLICE_BYTES
    tracemalloc.start()
    try:
        n = sum(p.num_rows for p in li._label(shared, li.SWITCH, None, li.MIN_SHARE)(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts)
    assert peak < 80 << 20
