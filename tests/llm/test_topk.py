import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import topk


def brute(rows, k, every=1):
    ok = [(i, e) for i, e in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    out = {}
    for q, a in ok:
        for n, b in ok:
            if n != q and q % every == 0 and len(a) == len(b):
                d = math.dist(a, b)
                best = out.setdefault(q, {})
                best[n] = min(d, best.get(n, math.inf))
    return {q: sorted((round(d, 6), n) for n, d in b.items())[:k] for q, b in out.items()}


def run(spark, rows, k, every=1):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk.search(df, k, None if every == 1 else F.col("vec_id") % every == 0).orderBy("vec_id", "rank").collect():
        found = got.setdefault(r.vec_id, [])
        assert r["rank"] == len(found) + 1
        found.append((r.distance, r.neighbor_id))
    return got


@pytest.mark.parametrize(("block", "visits", "every"), [(10, 7, 1), (37, 1000, 4), (1000, 1000, 1)])
def test_against_brute_force(spark, monkeypatch, block, visits, every):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "VISITS", visits)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 16)) * 4
    rows = [(i, [float(v) for v in np.round(middle[i % 6] + rng.normal(size=16), 2)]) for i in range(150)]
    assert run(spark, rows, 5, every) == brute(rows, 5, every)


def test_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(4)
    hot = [0.0, 1.0, -0.0, 2.0]
    rows = [(i, hot) for i in range(60)] + [(7, [float(v) for v in rng.normal(size=4)]) for _ in range(40)] + [(100 + i, [float(v) for v in rng.normal(size=4)]) for i in range(30)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 15)
    rnd = random.Random(2)
    rows = [(i % 20, [float(rnd.randint(0, 2)) for _ in range(6)]) for i in range(60)]
    rows += [(None, [0.0] * 6), (101, None), (102, []), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5), (105, [None] + [0.0] * 5), (106, [1.0, 2.0]), (107, [1.0]), (108, [1.0, 3.0])]
    assert run(spark, rows, 4) == brute(rows, 4)
    assert run(spark, [], 3) == {} and run(spark, [(1, [1.0])], 3) == {}


def test_repeats_stay_in_memory():
    """One id with very many vectors, and k of them as near as can be."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(10_000, 64))
    c = topk.Vectors(np.concatenate([x, x[:50] + 9]), np.concatenate([np.zeros(10_000, np.int64), np.arange(1, 51)]), np.arange(10_051))
    radius = np.full(20, np.inf)
    r, i, d = topk.nearest(x[:20], radius, c, 5)
    assert (np.bincount(r) == 5).all() and np.isfinite(radius).all() and (i.reshape(20, 5)[:, 0] == 0).all()
    exact = ((x[:20, None] - c.x[None, 10_000:]) ** 2).sum(axis=2)
    assert np.allclose(np.sort(exact, axis=1)[:, :4], d.reshape(20, 5)[:, 1:])


def test_bounds_are_below_distances():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 33))
    exact = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    last = None
    for s in (1, 4, 16):
        f = topk.summaries(x, s)
        bound = ((f[:, None] - f[None]) ** 2).sum(axis=2)
        assert (bound <= exact + 1e-9).all()
        last = bound
    assert last.mean() > 0.3 * exact.mean()
