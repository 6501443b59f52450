"""Whitening against eigenvectors of the covariance by numpy, and its parts against brute force."""

import math

import numpy as np
import pytest

from calltrace.llm import whitening
from calltrace.llm.bidiagonal import dqds, right_singular

SCHEMA = "vec_id long, embedding array<float>, label int, deviation string"


def test_dqds_relative_accuracy():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 17, 50):
        a, b = rng.standard_normal(d), rng.standard_normal(d - 1)
        want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
        assert np.allclose(dqds(a * a, b * b), want, rtol=1e-11, atol=0)
    graded = np.logspace(0, -30, 11)  # far below what a symmetric eigensolver keeps
    assert np.allclose(dqds(graded, np.zeros(10)), graded, rtol=1e-14, atol=0)
    assert dqds([], []).tolist() == [] and dqds([0.0, 1.0], [0.0]).tolist()[0] == 1.0


@pytest.mark.parametrize("kind", ["gauss", "graded", "twins", "identity", "orthogonal", "wide", "constant", "zero"])
def test_right_singular(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    x = {
        "gauss": rng.standard_normal((90, 24)), "graded": rng.standard_normal((90, 24)) * np.logspace(0, -6, 24), "twins": q @ np.diag([3.0] * 5 + [1.0] * 19) @ q.T, "identity": np.eye(24), "orthogonal": q,
        "wide": rng.standard_normal((4, 24)), "constant": np.ones((9, 24)), "zero": np.zeros((3, 24)),
    }[kind]
    r = np.linalg.qr(x, mode="r")
    squares, v, total = right_singular(r, 24)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    assert len(squares) == np.linalg.matrix_rank(x) and np.allclose(squares, want[: len(squares)], rtol=1e-10)
    assert np.allclose(v.T @ v, np.eye(len(squares)), atol=1e-10) and math.isclose(total, want.sum(), rel_tol=1e-12, abs_tol=1e-12)
    assert np.allclose(x.T @ x @ v, v * squares, atol=1e-9 * max(want[0], 1))


def brute(rows, components=8):
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v, *_ in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[r[j] - s[j] / n for j in range(d)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return good, n, dev, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((300, 12)) * np.linspace(1, 0.2, 12)
    rows = [(i, [float(np.float32(c)) for c in v], i % 3, "clash") for i, v in enumerate(base)]
    rows += [rows[5], rows[5], (None, rows[6][1], None, None)]
    rows += [(900, None, 1, None), (901, [None] * 12, 1, None), (902, [float("nan")] * 12, 1, None), (903, [math.inf] + [0.0] * 11, 1, None), (904, [], 1, None)]
    good, n, dev, want, share = brute([r for r in rows if r[1] is None or len(r[1])])
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op11_embedding_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    ids = [g[0] for g in good]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(8):
        mine = np.array([by[i, c + 1][0].whitened for i in ids])
        assert np.allclose(mine, want[:, c] * np.sign(mine @ want[:, c]), atol=1e-9)
        assert math.isclose(by[0, c + 1][0].explained, share[c], rel_tol=1e-12)
    assert all(by[i, 1][0].deviation == d for i, d in zip(ids, dev, strict=True)) and len(by[5, 1]) == 3


def test_large_numbers_and_odd_lengths(spark):
    """Deviations past 64 bits are exact; the most frequent length counts; extra columns stay."""
    big = [(i, [float(2**28 * (-1) ** i), float(i)], 0, "x") for i in range(6)] + [(50, [1.0, 2.0, 3.0], 0, "y"), (51, [2.0**31, 0.0], 0, "y")]
    df = spark.createDataFrame(big, SCHEMA)
    model = whitening.fit(df, components=3)
    assert model.n == 6 and len(model.eigenvalues) == 2
    out = {r.vec_id: r for r in whitening.whitened(df, model).collect()}
    good, n, dev, _, _ = brute(big[:6])
    assert set(out) == set(range(6)) and all(int(out[i].deviation_) == dev[i] for i in range(6)) and max(dev) > 1 << 64
    assert out[0].deviation == "x"


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0, "")], [(1, [1.0, 2.0], 0, "")], [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")]):
        df = spark.createDataFrame(rows, SCHEMA)
        model = whitening.fit(df)
        assert whitening.whitened(df, model).count() == 0 and len(model.eigenvalues) == 0
