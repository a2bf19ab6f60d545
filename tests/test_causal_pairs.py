"""Causal tests of many pairs at once give the single tests' results."""

import numpy as np
import pytest

from weftline.operators import causal_pairs, series


def rows(n=120, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.poisson(0.6, (14, n))
    x[1] = np.roll(x[0], 1)  # driven, without an error
    x[2] = np.roll(x[0], 2) + rng.poisson(0.2, n)
    x[3], x[4], x[5] = 0, 7, 0
    x[5, n // 2] = 1
    x[6] = 0
    x[6, -1] = 3  # only in the last bin: its lags are all zero
    x[7] = np.arange(n) % 2
    x[8] = x[7] * 40
    x[9] = np.arange(n)
    return x


@pytest.mark.parametrize("n", [1, 10, 24, 30, 120])
def test_many_tests_equal_single_ones(n):
    x = rows()[:, :n]
    lagged, shuffled = causal_pairs.Lagged(x), causal_pairs.Shuffled(x)
    every = np.arange(len(x))
    p = np.array([lagged.granger(every, t) for t in every])
    z = np.array([shuffled.z(s, every) for s in every])
    for s in every:
        for t in every:
            if s != t:
                assert p[t, s] == pytest.approx(series.granger(x[s].astype(float), x[t].astype(float)), rel=1e-5, abs=1e-9), (s, t)
                if n > 1:
                    assert z[s, t] == pytest.approx(series.transfer_entropy_z(x[s].astype(float), x[t].astype(float)), abs=1e-8), (s, t)


def test_tails():
    rng = np.random.RandomState(2)
    f, k, d = rng.exponential(2, 500) * (rng.rand(500) > 0.1), rng.randint(1, 6, 500).astype(float), rng.randint(3, 200, 500).astype(float)
    assert causal_pairs.f_tails(f, k, d) == pytest.approx([series.f_tail(*v) for v in zip(f, k, d)], abs=1e-11)


@pytest.mark.parametrize("every", [True, False])
def test_edges_in_a_broadcast_and_in_a_join(spark, monkeypatch, every):
    x = rows()[:, :60]
    df = spark.createDataFrame([(f"k{i}", j, int(v)) for i, s in enumerate(x) for j, v in enumerate(s)], "key string, bin long, n long")
    edges = spark.createDataFrame([(f"k{i}", f"k{j}") for i in range(14) for j in range(14) if i != j], "src string, dst string")
    get = lambda **o: {(r.src, r.dst): (r.granger_p, r.te_z) for r in series.causal_tests(df, "key", edges, **o).collect()}
    together = get(every=every)
    assert series.causal_tests(df, "key", edges.limit(0), every=every).count() == 0
    assert series.causal_tests(df.limit(0), "key", edges, every=every).count() == 0
    plan = series.causal_tests(df, "key", edges)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInPandas" in plan
    monkeypatch.setattr(series, "SERIES_BYTES", 10)
    joined = get()
    assert together.keys() == joined.keys() and len(joined) == 14 * 13
    for k, (p, z) in joined.items():
        assert together[k][0] == pytest.approx(p, rel=1e-5, abs=1e-9)
        assert together[k][1] == (None if not every and p < 0.05 else pytest.approx(z, abs=1e-8)), k
