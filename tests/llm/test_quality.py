import random

import numpy as np
import pytest

from sieveline.llm import quality

GOOD = [f"calm{i}" for i in range(300)]
BAD = ["vileword", "hatefulish", "nastyone"]


def make(seed, n=600):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(GOOD) for _ in range(rnd.randint(20, 120))]
        kind = rnd.random()
        toxic, low = kind < 0.15, 0.15 <= kind < 0.3
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(BAD)
        text = " ".join(w.upper() + "!!" for w in words) if low else " ".join(words) + "."
        rows.append((i, text))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = make(1)
    docs, marks = frames(spark, rows, [x for x in labels if x[0] < 400])
    got = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    bad = {i for i, q, t in labels if t or not q}
    held = range(400, 600)
    good_scores = np.array([got[i].score for i in held if i not in bad])
    bad_scores = np.array([got[i].score for i in held if i in bad])
    assert (good_scores[:, None] > bad_scores[None]).mean() > 0.99
    assert np.mean([got[i].keep == (i not in bad) for i in held]) > 0.93


def test_kept_agrees_with_classify_and_the_quantile(spark):
    rows, labels = make(2, 300)
    docs, marks = frames(spark, rows, labels)
    docs = docs.selectExpr("*", "'en' as lang", "1 as score", "2 as keep", "3 as bad")
    flagged = quality.classify(docs, marks, 0.4).collect()
    assert sum(not r.keep for r in flagged) == pytest.approx(120, abs=2)
    kept = quality.kept(docs, marks, 0.4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in flagged if r.keep)
    assert all(r.score < s.score for r in flagged if not r.keep for s in flagged if s.keep)


def test_odd_rows(spark):
    rows, labels = make(3, 120)
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "calm1 calm2"), (5, rows[5][1]), (1003, "calm3 " * 200_000)]
    labels += [(5, 1, 0), (5, 0, None), (None, 1, 0), (77777, 1, 1), (6, None, 1)]
    docs, marks = frames(spark, rows, labels)
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].score is None and not by[i][0].keep for i in (1000, 1001, 1002))
    assert by[5][0] == by[5][1] and by[None][0].score is not None
    assert quality.classify(docs.limit(0), marks).count() == 0
    none = quality.classify(docs, marks.limit(0)).collect()
    assert all(r.keep == (r.score is not None) for r in none) and {r.score for r in none} == {0.0, None}
    one_kind = quality.classify(docs, marks.filter("quality = 1 and toxic = 0 and doc_id <> 5")).collect()
    assert all(r.keep == (r.score is not None) for r in one_kind)


def test_gradient_prefers_the_good():
    rng = np.random.default_rng(1)
    stats = rng.normal(size=(40, len(quality.STATS))).astype(np.float32)
    good = np.arange(40) < 20
    doc = np.arange(40)
    mark = np.where(good, 7, 9).astype(np.uint32)
    m = quality.fit_pairs(stats, doc, mark, good)
    assert m.marks.tolist() == [7, 9] and m.weight[0] > 0 > m.weight[1]


def test_all_pairs_count():
    rng = np.random.default_rng(5)
    stats, good = rng.normal(size=(60, len(quality.STATS))), np.arange(60) % 3 > 0
    none = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    by = rng.permutation(60)
    one, other = quality.fit_pairs(stats, *none, good), quality.fit_pairs(stats[by], *none, good[by])
    assert np.abs(one.stat).max() > 0.1 and np.allclose(one.stat, other.stat, atol=1e-6)
    a, b = rng.normal(size=700) * 5, rng.normal(size=900) * 5
    push = -1 / (1 + np.exp(a[:, None] - b[None]))
    by_good, by_bad = quality.pushes(a, b)
    assert np.allclose(by_good, push.mean(axis=1) / len(a), atol=1e-12) and np.allclose(by_bad, -push.mean(axis=0) / len(b), atol=1e-12)


def test_toxic_without_quality_is_bad(spark):
    docs = spark.createDataFrame([(i, f"calm{i} calm") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, None, 1), (1, 1, 0), (2, 1, None), (3, None, 0), (4, None, None), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels)[1] == 0.5


def test_against_brute_force(spark):
    """The whole of classify, with the ranking fitted pair by pair and word by word."""
    import pyarrow as pa

    rows, marks = make(7, 70)
    rows += [(90, None), (91, "..."), (92, rows[1][1])]
    got = {r.doc_id: r for r in quality.classify(*frames(spark, rows, marks)).collect()}
    bad = {i for i, q, t in marks if t or not q}
    known = [i for i, *_ in marks]
    stats, owner, mark = quality.features(pa.array([t for _, t in rows], pa.string()))
    words = [set(mark[owner == i].tolist()) for i in range(len(rows))]
    share = len(bad) / len(known)

    def differs(m):
        has = [i for i in known if m in words[i]]
        return len(has) >= quality.MIN_DOCS and abs(sum(i in bad for i in has) - share * len(has)) / np.sqrt(share * (1 - share) * len(has)) >= quality.Z

    chosen = sorted(m for m in set().union(*(words[i] for i in known)) if differs(m))
    sample = stats[known]
    z = np.clip((stats - sample.mean(axis=0)) / (sample.std(axis=0) + 1e-6), -6, 6)
    x = np.array([[float(m in words[i]) for m in chosen] + [*z[i], *np.abs(z[i]), *np.maximum(0, z[i] - 2)] for i in range(len(rows))])
    pairs = [(i, j) for i in known if i not in bad for j in bad]
    theta, first, second = (np.zeros(x.shape[1]) for _ in range(3))
    steps = np.array([x[i] - x[j] for i, j in pairs])
    for step in range(1, quality.ROUNDS + 1):
        push = -1 / (1 + np.exp(steps @ theta))
        grad = (push[:, None] * steps).mean(axis=0) + quality.L2 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta - 0.05 * (1 - step / (quality.ROUNDS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    want = x @ theta
    here = [i for i, (d, t) in enumerate(rows) if words[i]]
    assert chosen and all(abs(got[rows[i][0]].score - want[i]) < 1e-3 for i in here)
    ranked = sorted(want[i] for i in here)
    limit = ranked[max(0, int(np.ceil(share * len(ranked))) - 1)]
    assert all(got[rows[i][0]].keep == (want[i] >= limit - 1e-9) for i in here if abs(want[i] - limit) > 2e-3)
    assert got[90].score is None and not got[91].keep and len(got) == len(rows)
