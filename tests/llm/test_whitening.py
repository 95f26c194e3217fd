"""Whitening against a dense eigendecomposition in numpy; the solver on matrices with near, equal and vanishing eigenvalues."""

import math

import numpy as np
import pytest

from phrasemill.llm import op13_embedding_whitening as op13

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, pos int"


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 0, -1, "clash", -1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors, dim):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)) for v in vectors], object)
    n, s = len(x), x.sum(0)
    t = x * n - s
    y = t.astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return [int((r * r).sum()) for r in t], y, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("dim,wanted", [(64, 32), (200, 20), (40, 40), (5, 3), (1, 1)])
def test_leading_pairs(dim, wanted):
    rng = np.random.default_rng(dim)
    spread = np.linspace(1, 2, dim)
    spread[: dim // 4] = spread[0]  # equal ones
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    a = (q * spread) @ q.T
    e, v = op13.leading(lambda u: a @ u, dim, wanted)
    assert np.abs(e - np.sort(spread)[::-1][:wanted]).max() < 1e-12 and np.abs(v.T @ v - np.eye(wanted)).max() < 1e-12
    assert np.abs(a @ v - v * e).max() < 1e-12
    assert np.abs(op13.leading(lambda u: 0 * u, dim, wanted)[0]).max() == 0


def test_minres():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    assert np.abs(a @ op13.minres(lambda u: a @ u, b, 200, 1e-13) - b).max() < 1e-8


def test_against_dense(spark):
    rng = np.random.default_rng(3)
    good = [list(map(float, v)) for v in rng.standard_normal((300, 40)) * np.linspace(0.2, 2, 40)] + [[0.0] * 40, [1.0] * 7, []]
    bad = [None, [None, 1.0], [math.nan] * 40, [math.inf] + [0.0] * 39, [-math.inf]]
    ids = [*range(300), 5, None, -7, 900, 901, 902, 903, 904]
    got = op13.whitening(frame(spark, good + bad, ids)).toPandas()
    deviation, y, e, u = plain(good, 40)
    assert len(got) == 32 * len(good) and set(got.n) == {len(good)} and got.identity_error.max() < 1e-10
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    one = got[got.vec_id.isin(range(300)) & (got.vec_id != 5)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (y @ u / np.sqrt(e))[[i for i in range(300) if i != 5], :32]
    sign = np.sign((one * want).sum(0))
    assert np.abs(one * sign - want).max() < 1e-8
    assert np.abs(got.drop_duplicates("component").sort_values("component").explained.to_numpy() / (e[:32] / e.sum()) - 1).max() < 1e-10


def test_few_and_flat_vectors(spark):
    assert op13.whitening(frame(spark, [])).collect() == [] and op13.whitening(frame(spark, [None, [None]])).collect() == [] and op13.whitening(frame(spark, [[], []])).collect() == []
    same = op13.whitening(frame(spark, [[0.5, 1.0]] * 3)).collect()
    assert len(same) == 6 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error == 0 for r in same)
    line = op13.whitening(frame(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert sorted(round(abs(r.whitened), 9) for r in line if r.component == 1) == [0, round(1.5**0.5, 9), round(1.5**0.5, 9)] and all(r.whitened is None for r in line if r.component == 2)


def test_exact_deviations_of_large_entries(spark):
    vectors = [[2.0**30, -1.0], [0.0, 2.0**20], [-(2.0**30), 3.0]]
    got = op13.whitening(frame(spark, vectors)).collect()
    deviation = plain(vectors, 2)[0]
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)} and None in {r.deviation for r in got}


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in rng.standard_normal((100, 6))]
    a = op13.whitening(frame(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    monkeypatch.setattr(op13, "BLOCK_BYTES", 100)
    b = op13.whitening(frame(spark, vectors).repartition(7)).toPandas().sort_values(["vec_id", "component"])
    assert (a.deviation.to_numpy() == b.deviation.to_numpy()).all() and np.abs(np.abs(a.whitened.to_numpy()) - np.abs(b.whitened.to_numpy())).max() < 1e-9
