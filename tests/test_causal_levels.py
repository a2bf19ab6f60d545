"""The search on the cluster against the one in one place."""

import numpy as np
import pytest

from weftline.operators import causal_graph, causal_levels


def table(spark, x, names=None):
    names = names or [f"n{i:03d}" for i in range(len(x))]
    return spark.createDataFrame([(names[i], j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "k string, bin int, n double")


def in_one_place(x, names):
    corr = np.nan_to_num(np.corrcoef(x))
    np.fill_diagonal(corr, 1.0)
    g = causal_graph.pc(names, corr, x.shape[1])
    return {(u, v, True) for u, v in g.directed} | {(u, v, False) for u, v in g.undirected}


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_equals_the_search_in_one_place(spark, seed, monkeypatch):
    monkeypatch.setattr(causal_levels, "BLOCK", 4)
    monkeypatch.setattr(causal_levels, "TESTS", 10)
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(11, 600))
    for i in range(1, 10):
        for j in rng.choice(i, min(i, 2), replace=False):
            x[i] += 0.6 * x[j]
    x[10] = 3.0  # flat
    names = [f"n{i:03d}" for i in range(11)]
    got = {tuple(r) for r in causal_levels.causal_graph(table(spark, x), "k").collect()}
    assert got == in_one_place(x, names) and got


def test_colliders_chains_and_interventions(spark):
    rng = np.random.RandomState(2)
    a, b = rng.normal(size=1000), rng.normal(size=1000)
    c = a + b + 0.3 * rng.normal(size=1000)
    d = c + 0.3 * rng.normal(size=1000)
    e = rng.normal(size=1000)
    f = e + 0.5 * rng.normal(size=1000)
    g = causal_levels.causal_graph(table(spark, np.array([a, b, c, d, e, f]), list("abcdef")), "k")
    assert {tuple(r) for r in g.collect()} == {("a", "c", True), ("b", "c", True), ("c", "d", True), ("e", "f", False)}
    out, conflicts = causal_levels.intervened(g, spark.createDataFrame([("f",), ("c",)], "s string"))
    assert {tuple(r) for r in out.collect()} == {("a", "c", True), ("b", "c", True), ("c", "d", True), ("f", "e", True)}
    assert {tuple(r) for r in conflicts.collect()} == {("c", "a"), ("c", "b")}


def test_few_bins_claim_no_edge(spark):
    x = np.ones((3, 10)) * np.arange(10)
    assert causal_levels.causal_graph(table(spark, x), "k").count() == 0
    assert causal_levels.causal_graph(table(spark, x).limit(0), "k").count() == 0


def test_five_hundred_series(spark):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(500, 80))
    x[1::2] += 2.0 * x[::2]  # 250 pairs
    df = spark.createDataFrame([(f"n{i:03d}", x[i].tolist()) for i in range(500)], "k string, y array<double>")
    series = df.selectExpr("k", "posexplode(y) as (bin, n)")
    edges, _ = causal_levels.skeleton(series, "k", alpha=1e-9, most=1)
    assert {tuple(r) for r in edges.collect()} == {(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 500, 2)}
