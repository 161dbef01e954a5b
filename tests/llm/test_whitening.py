import numpy as np
import pytest

from fleetspark.llm import whitening as W

rng = np.random.default_rng(4)


def triangle(x):
    return np.linalg.qr(x, mode="r")


@pytest.mark.parametrize("a", [triangle(rng.standard_normal((300, d)) * np.logspace(0, -g, d)) for d in (1, 2, 7, 40) for g in (0, 5)], ids=str)
def test_solver(a):
    values, axes = W.principal(a)
    expected = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(values, expected, rtol=1e-11, atol=0)
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-11 and np.abs(a.T @ (a @ axes) - axes * values).max() < 1e-12 * values[0]


def test_solver_on_equal_and_zero_values():
    for a in (np.eye(6), np.diag([3.0, 3, 1, 1, 0]), np.zeros((3, 3)), triangle(rng.standard_normal((50, 2)) @ rng.standard_normal((2, 9))), np.array([[0.0]])):
        values, axes = W.principal(a)
        assert np.allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, atol=1e-12 * max(1.0, values.max()))
        assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-9 and np.abs(a.T @ (a @ axes) - axes * values).max() < 1e-9 * max(1.0, values.max())
    # clusters of equal values, held together by rounding alone
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0] * np.repeat([5.0, 1.0], 15)
    values, axes = W.principal(triangle(q @ np.linalg.qr(rng.standard_normal((30, 30)))[0]))
    assert np.allclose(values, np.repeat([25.0, 1.0], 15)) and np.abs(axes.T @ axes - np.eye(30)).max() < 1e-5


def test_dqds_keeps_small_values():
    """A graded bidiagonal whose least values a covariance would lose."""
    d, e = np.logspace(0, -12, 9), np.logspace(-1, -13, 8)
    b = np.diag(d) + np.diag(e, 1)
    product = np.prod(W.dqds(d, e))
    assert abs(product / np.prod(d**2) - 1) < 1e-12 and abs(W.dqds(d, e)[0] / np.linalg.svd(b, compute_uv=False)[0] ** 2 - 1) < 1e-13


def brute(rows, k=8):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    given = [j for j in range(min(k, len(e))) if e[j] > 1e-9 * e[0]]
    return {(i, j + 1, sum(int(y) ** 2 for y in n * x[r] - s)): (c[r] @ v[:, j] / np.sqrt(e[j]), e[j] / e.sum(), n) for r, (i, _) in enumerate(kept) for j in given}


def same(got, expected):
    assert sorted({(r.vec_id, r.component, r.deviation) for r in got}) == sorted(expected) and len(got) == expected[next(iter(expected))][2] * len({r.component for r in got})
    sign = {}
    for r in got:
        y, share, n = expected[r.vec_id, r.component, r.deviation]
        if abs(y) > 0.3:
            sign.setdefault(r.component, np.sign(y) * np.sign(r.whitened))
    for r in got:
        y, share, n = expected[r.vec_id, r.component, r.deviation]
        assert abs(r.whitened * sign[r.component] - y) < 1e-8 and abs(r.explained / share - 1) < 1e-9 and r.n == n and r.identity_error < 1e-9


@pytest.mark.parametrize("d,parts", [(3, 1), (12, 40)])
def test_same_as_brute_force(spark, d, parts):
    vectors = rng.standard_normal((500, d)) * np.linspace(3, 0.5, d) + 7
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(600, None), (601, []), (602, [float("nan")] * d), (603, [None] + [1.0] * (d - 1)), (604, [float("inf")] * d), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, x int").repartition(parts)
    same(W.digest(df).collect(), brute(rows))


def test_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert W.digest(df([])).collect() == [] and W.digest(df([])).columns == W.digest(df([(1, [1.0]), (2, [2.0])])).columns
    assert W.digest(df([(1, [1.0, 2.0])] * 3)).collect() == []  # no variance
    line = W.digest(df([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    assert {r.vec_id for r in W.digest(df([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (None, [5.0, 5.0])])).collect()} == {1, 2, None}
    with pytest.raises(Exception, match="exact deviation"):
        W.digest(df([(1, [1e300]), (2, [0.0])])).collect()
