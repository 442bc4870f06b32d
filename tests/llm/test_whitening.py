import math
import random
from fractions import Fraction

import numpy as np

from papyra.llm import whitening

EMB = "vec_id long, embedding array<float>, label int, x string, n string"


def brute(rows, top=16):
    """Fractions for n, sums, covariance and deviation; eigenvectors of the exact matrix."""
    ok = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in ok))
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in fit) / n)
                     for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:top], u[:, ::-1][:, :top]
    out = {}
    for i, x in ok:
        dev = np.array([float(x[j] - Fraction(s[j], n)) for j in range(d)])
        out.setdefault(i, (sum((n * x[j] - s[j]) ** 2 for j in range(d)), dev @ u / np.sqrt(e)))
    return n, out, e / np.trace(cov), len(ok)


def f32(x):
    return float(np.float32(x))


def make(n, dim, seed):
    rng = random.Random(seed)
    rows = [(i, [f32(rng.gauss(0, 1 + j % 5)) for j in range(dim)]) for i in range(n)]
    return rows + [(None, rows[0][1]), (n + 1, None), (n + 2, [1.0, None] * (dim // 2)), (n + 3, [float("nan")] * dim),
                   (n + 4, [float("inf")] * dim), (n + 5, rows[1][1]), (1, rows[1][1])]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows], EMB).repartition(4)
    got = whitening.whiten(df, **kw).collect()
    assert not got or got[0].__fields__ == [c.split()[0] for c in whitening.OUT.split(", ")]
    return got


def check(spark, rows, top=16):
    n, want, explained, kept = brute(rows, top)
    got = run(spark, rows, components=top)
    assert len(got) == kept * len(explained) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-8
    sign = {}
    for r in got:
        deviation, w = want[r.vec_id]
        assert r.deviation == deviation and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        x = w[r.component - 1]
        if abs(x) > 0.1:
            assert sign.setdefault(r.component, r.whitened * x > 0) == (r.whitened * x > 0)
        assert abs(abs(r.whitened) - abs(x)) < 1e-6


def test_matches_exact_arithmetic(spark, monkeypatch):
    check(spark, make(200, 20, 1))
    monkeypatch.setattr(whitening, "PLANE_ROWS", 70)
    check(spark, make(90, 6, 2), 4)


def test_popcounts_are_cross_products():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 900, (130, 5))
    x[:, 2] = 7
    low = x.min(axis=0)
    bits = np.array([int(b).bit_length() for b in x.max(axis=0) - low])
    cols = whitening.by_weight(whitening.popcounts(whitening.planes(x, low, bits)), bits)
    cross = np.zeros((6, 6), object)
    for i, j, s, ones in zip(*cols.values()):
        cross[i, j] += int(ones) << int(s)
    y = np.hstack([x - low, np.ones((130, 1), np.int64)])
    assert (np.triu(y.T @ y) == cross).all()


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [])]) == []      # no variance
    got = run(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0])])            # one direction; another width
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9)) for r in got) == [(1, 1, 2, 1.0), (2, 1, 2, 1.0)]


def test_graded_and_huge_values(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1) * 1e9, rng.gauss(0, 3)]) for i in range(300)]
    got = run(spark, [(i, [f32(c) for c in v]) for i, v in rows])
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-6
    got = run(spark, [(i, [3.0e38 if i == 7 else f32(v[0]), f32(v[2])]) for i, v in rows])
    assert len(got) == 600 and all(math.isfinite(r.whitened) for r in got)
    assert any(r.deviation is None for r in got)


def test_dependent_dimensions(spark):
    rng = random.Random(6)
    rows = [(i, [a, a, 0.5, b]) for i in range(100) for a, b in [(rng.randint(-64, 64) / 64, rng.randint(-64, 64) / 64)]]
    got = run(spark, rows)
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
