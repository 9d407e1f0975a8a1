import math

import numpy as np
import pytest

from sojourn.llm import queries, spectral, whitening

SCHEMA = "vec_id long, embedding array<float>"


def matrices():
    draws = np.random.default_rng(3)
    turn, _ = np.linalg.qr(draws.standard_normal((40, 40)))
    steep = (turn * np.logspace(0, -9, 40)) @ turn.T
    low = draws.standard_normal((6, 30))
    close = (turn * np.r_[2.0, 1 + 1e-9, 1.0, np.linspace(0, 0.5, 37)]) @ turn.T
    yield from (steep, low.T @ low, close, np.eye(7), np.zeros((3, 3)), np.diag([3.0, 3, 1, 0, 0]), np.ones((9, 9)), np.diag([-1.0, 2, -3]))
    yield from (np.array([[4.0]]), 1e200 * np.diag([1.0, 2.0]), 1e-200 * np.diag([1.0, 2.0]))


@pytest.mark.parametrize("a", list(matrices()), ids=lambda a: str(len(a)))
def test_eigenvectors(a):
    values, vectors = spectral.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values / size, np.linalg.eigvalsh(a)[::-1] / size, atol=1e-13 * len(a))
    assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * len(a) * size


def test_polar_factor():
    draws = np.random.default_rng(4)
    turn, _ = np.linalg.qr(draws.standard_normal((20, 20)))
    values = np.r_[np.linspace(-5, -1e-6, 9), np.linspace(1e-7, 3, 11)]
    assert np.allclose(spectral.polar((turn * values) @ turn.T), (turn * np.sign(values)) @ turn.T, atol=1e-8)


def plain(rows):
    """The results by numpy's eigenvectors and Python's whole numbers; None where a row does not count."""
    xs = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            xs[i] = tuple(math.floor(256 * float(np.float32(c))) for c in v)
    lengths = [len(x) for x in set(xs.values())]
    length = max(set(lengths), key=lambda k: (lengths.count(k), k))
    fitted = sorted({x for x in xs.values() if len(x) == length})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    away = np.array(fitted, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in xs.items():
        if len(x) == length:
            d = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            y = (np.array(x) - np.array([s / n for s in sums])) @ vectors[:, :4] / np.sqrt(values[:4])
            out += [(rows[i][0], k + 1, n, d, y[k], values[k] / values.sum()) for k in range(min(4, length))]
    return out


def agree(got, want):
    key = lambda r: (repr(r[0]), r[1], r[3], abs(round(r[4], 6)))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and abs(abs(g[4]) - abs(w[4])) <= 1e-7 and abs(g[5] - w[5]) <= 1e-9 and g[6] <= 1e-9
        if abs(w[4]) > 1e-6:
            signs.setdefault(g[1], set()).add(np.sign(g[4]) == np.sign(w[4]))
    # One sign for all rows of a component.
    assert all(len(s) == 1 for s in signs.values())


def test_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    agree(queries.QUERIES["op11_whitening"](spark, sf_dir).collect(), plain(rows))


def vectors(n, length, seed=1):
    draws = np.random.default_rng(seed)
    return [(i, [float(c) for c in draws.standard_normal(length) * np.linspace(1, 3, length)]) for i in range(n)]


def test_rows_that_do_not_count(spark):
    rows = vectors(60, 5)
    rows += [rows[0], (7, rows[3][1]), (None, rows[4][1]), (100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] + [0.0] * 4)]
    rows += [(104, [math.inf] + [0.0] * 4), (105, [1.0] * 6), (106, [-0.0] * 5), (107, [0.0] * 5), (108, [1e-12, -1e-12, 0.0, 0.0, 0.0]), (109, [3e38] + [0.0] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "2 as vector", "3 as component", "4 as n")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    agree(got, [r for r in plain([r for r in rows if r[0] != 109])])
    assert {r["vec_id"] for r in got} == {*range(60), None, 106, 107, 108}


def test_degenerate_tables(spark):
    for rows, n in (([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [1.0, 2.0])] * 3, 6), ([(1, [1.0, 5.0]), (2, [2.0, 5.0])], 4), ([(1, [0.5]), (2, [0.25])], 2)):
        df = spark.createDataFrame(rows, SCHEMA)
        got = whitening.whiten(df, whitening.fit(df)).collect()
        assert len(got) == n and all(math.isfinite(r["whitened"]) and r["identity_error"] <= 1e-9 for r in got)
        assert {r["whitened"] for r in got if r["component"] == 2} <= {0.0}
    line = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], SCHEMA)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(line, whitening.fit(line)).collect()}
    assert abs(got[1, 1]["whitened"]) == 1.0 and got[1, 1]["explained"] == 1.0 and got[1, 1]["deviation"] == 256**2


def test_general_use(spark):
    rows = vectors(80, 6, seed=2)
    df = spark.createDataFrame(rows, "name long, v array<double>")
    model = whitening.fit(df, "v", components=6)
    assert model.components.shape == (6, 6) and model.identity_error < 1e-10 and abs(sum(model.values) - model.trace) < 1e-8 * model.trace
    assert whitening.whiten(df, model, "v", "name").count() == 480


def test_whole_numbers_beyond_a_long():
    x = np.array([[2**40, 1], [3, 4]])
    sums = (2**40 + 3, 5)
    want = [sum((10**6 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, 10**6, sums) == [d if d < 2**63 else None for d in want] and whitening.deviations(x, 10**6, sums)[0] is None
    assert whitening.deviations(x[1:], 2, (7, 9)) == [2]
