"""Models fitted over all rows against the same steps in one place; regimes, windows, posteriors."""

import copy
import math

import numpy as np
import pytest

from weftline.operators import hmm, sequences

TYPES = "service string, trace string, symbols array<string>, at int"


def table(spark, rows):
    return spark.createDataFrame(rows, TYPES).repartition(5)


@pytest.fixture(scope="module")
def mixed(spark):
    """Service s has two kinds of trajectories, service t one, few nothing to fit."""
    rng = np.random.RandomState(3)
    rows = [("s", f"a{i:02d}", ["up", "run"] * rng.randint(3, 7), i) for i in range(25)]
    rows += [("s", f"b{i:02d}", ["stop", "wait", "stop", "fail"] * rng.randint(2, 4), i) for i in range(15)]
    rows += [("t", f"c{i:02d}", [str(x) for x in rng.choice(list("xyz"), rng.randint(4, 9))], i) for i in range(30)]
    return rows + [("few", "d", ["x", "y"], 0)]


def in_one_place(rows, service, models, rounds, step):
    """The same rounds over one list of sequences."""
    mine = [r for r in rows if r[0] == service]
    at = {s: i for i, s in enumerate(sorted({s for r in mine for s in r[2]}))}
    seqs = [np.array([at[s] for s in r[2]]) for r in mine]
    for _ in range(rounds):
        live = [m for m in models if not m.done]
        if not live:
            break
        for m in live:
            step(m, sum(hmm.statistics(*sequences.padded([q]), m) for q in seqs))
    return seqs


def test_statistics_equal_the_plain_recursions():
    rng = np.random.RandomState(1)
    m = hmm.random_model(2, 3, 4, 7)
    seqs = [rng.randint(0, 4, n) for n in (1, 5, 9, 2)]
    whole = hmm.split(hmm.statistics(*sequences.padded(seqs), m), m)
    want = [0.0, 0.0, np.zeros(2), np.zeros(2), np.zeros((2, 3)), np.zeros((2, 3, 3)), np.zeros((2, 3, 4))]
    for q in seqs:
        ll = np.array([sequences.log_likelihood(q, m.start[k], m.move[k], m.emit[k]) for k in range(2)])
        r = np.exp(m.log_mix + ll) / np.exp(m.log_mix + ll).sum()
        want[0] += r @ ll
        want[1] -= (r * np.log(r)).sum()
        want[2] += r
        want[3][r.argmax()] += 1
        for k in range(2):
            s, mv, e, _ = sequences._expected(*sequences.padded([q]), m.start[k], m.move[k], m.emit[k])
            want[4][k] += r[k] * s
            want[5][k] += r[k] * mv
            want[6][k] += r[k] * e
    assert all(np.allclose(a, b) for a, b in zip(whole, want))


def test_mixtures_over_all_rows_equal_one_place(spark, mixed, monkeypatch):
    monkeypatch.setattr(hmm, "CELLS", 60)
    data, facts = hmm.encoded(table(spark, mixed), "service")
    got = hmm.fit_mixtures(data, facts, 3, 2, 12)
    assert set(got) == {"s", "t"}
    for service in "st":
        alphabet, m = got[service]
        plain = hmm.mixtures(len(alphabet), 3, 2)
        in_one_place(mixed, service, plain, 12, hmm.improve)
        best = hmm.best_mixture(plain)
        assert m.regimes == best.regimes and m.bound == pytest.approx(best.bound, rel=1e-9)
        assert np.allclose(m.emit, best.emit, atol=1e-8) and np.allclose(m.log_mix, best.log_mix, atol=1e-8)
    assert got["s"][1].regimes >= 2
    out = {r.trace: r for r in hmm.regime_anomalies(table(spark, mixed), "service", most=3, restarts=2, rounds=12).collect()}
    assert len(out) == 70 and len({out[t].regime for t in out if t[0] == "a"} & {out[t].regime for t in out if t[0] == "b"}) == 0
    for service in "st":
        alphabet, m = got[service]
        at = {s: i for i, s in enumerate(alphabet)}
        mine = [r for r in mixed if r[0] == service]
        ll = np.array([[sequences.log_likelihood(np.array([at[s] for s in r[2]]), m.start[k], m.move[k], m.emit[k]) for k in range(m.regimes)] for r in mine])
        z = (m.log_mix + ll).argmax(axis=1)
        step = ll[np.arange(len(mine)), z] / [len(r[2]) for r in mine]
        for k in set(z):
            limit = np.percentile(step[z == k], 5)
            for r, v in zip([r for r, g in zip(mine, z) if g == k], step[z == k]):
                o = out[r[1]]
                assert (o.regime, o.per_step, o.threshold) == (k, pytest.approx(v, abs=1e-7), pytest.approx(limit, abs=1e-7))
                assert (o.confidence is None) == (not o.anomalous)
                if o.anomalous:
                    assert o.confidence == pytest.approx(1 / (1 + math.exp(o.per_step - o.threshold))) and o.confidence >= 0.5
                likely = [m.emit[k, :, at[s]].max() for s in r[2]]
                assert likely[o.change_at] == min(likely) and o.change == r[2][o.change_at]


def test_plain_models_by_bic(spark, mixed):
    data, facts = hmm.encoded(table(spark, mixed), "service")
    got = hmm.plain_models(data, facts, 4, 20)
    for service in "st":
        alphabet, m = got[service]
        a = len(alphabet)
        plain = [hmm.random_model(1, k, a, 0) for k in range(2, min(4, a) + 1)]
        seqs = in_one_place(mixed, service, plain, 20, hmm.improve)
        n = sum(map(len, seqs))
        want = min(plain, key=lambda p: -2 * p.bound + (p.states**2 - 1 + p.states * (a - 1)) * math.log(n))
        assert m.states == want.states and m.bound == pytest.approx(want.bound, rel=1e-9)


def test_groups_of_keys_give_the_same_models(spark, mixed, monkeypatch):
    data, facts = hmm.encoded(table(spark, mixed), "service")
    whole = hmm.plain_models(data, facts, 3, 5)
    monkeypatch.setattr(hmm, "MODEL_BYTES", 600)
    parts = hmm.plain_models(data, facts, 3, 5)
    assert whole.keys() == parts.keys() and all(np.allclose(whole[k][1].emit, parts[k][1].emit) for k in whole)
    monkeypatch.setattr(hmm, "GROUPS", 0)
    with pytest.raises(ValueError):
        hmm.plain_models(data, facts, 3, 5)


def test_windows_separate_maintenance_from_normal(spark):
    rng = np.random.RandomState(5)
    rows = []
    for s in ("web", "db"):
        for i in range(24):
            kinds = ["get", "put", "get", "ok"] if i < 12 else ["drain", "patch", "boot", "drain"]
            rows.append((s, f"{s}{i:02d}", [kinds[j % 4] for j in range(rng.randint(6, 10))], i))
    windows, models, turns = hmm.two_levels(table(spark, rows), "service", "at", 2, 8, 6, most=1, restarts=1, rounds=6)
    z = [r.global_regime for r in sorted(windows.collect(), key=lambda r: r.window)]
    assert len(set(z[:4])) == len(set(z[4:])) == 1 and z[0] != z[7] and 1 <= turns <= 6
    assert set(models) == {f"{g}|{s}" for g in (0, 1) for s in ("web", "db")}
    # a start that mixes both kinds ends in the same windows, and each window's score is the plain sum
    for r in windows.collect():
        total = 0.0
        for s, t, symbols, i in rows:
            if min(7, i * 8 // 24) == r.window:
                alphabet, m = models[f"{r.global_regime}|{s}"]
                total += max(sequences.log_likelihood(np.array([alphabet.index(x) for x in symbols]), m.start[k], m.move[k], m.emit[k]) for k in range(m.regimes))
        assert r.log_likelihood == pytest.approx(total, rel=1e-6) and r.services == ["db", "web"]


def test_variational_fit_equals_one_place(spark, mixed):
    got = {r.trace: r for r in hmm.variational_confidence(table(spark, mixed), "service", sizes=(2, 3), restarts=2, rounds=10, draws=40).collect()}
    assert len(got) == 70
    for service in "st":
        mine = [r for r in mixed if r[0] == service]
        a = len({s for r in mine for s in r[2]})
        plain = [hmm.variational_model(k, a, 17 * r + 11) for k in (2, 3) for r in range(2)]
        seqs = in_one_place(mixed, service, plain, 10, hmm.improve_posterior)
        best = max(plain, key=lambda m: m.bound)
        old = sequences.fit_vb_hmm(seqs, best.states, a, 10, 1)
        assert best.bound > old[3] - 30  # the same bound as the plain fit's, from another start
        d = hmm.drawn(best, 40, 1)
        step = np.array([hmm.log_likelihoods(*sequences.padded([q]), d)[:, 0] / len(q) for q in seqs])
        mean, sd = step.mean(axis=1), step.std(axis=1, ddof=1)
        limit = np.percentile(mean, 5)
        for r, m, s in zip(mine, mean, sd):
            o = got[r[1]]
            assert (o.states, o.per_step, o.deviation, o.threshold) == (best.states, *map(lambda v: pytest.approx(v, abs=1e-6), (m, s, limit)))
            assert o.confidence == pytest.approx(0.5 * (1 + math.erf((limit - m) / s / math.sqrt(2))), abs=1e-5)


def test_posterior_counts_grow_with_the_rows(spark, mixed):
    m = hmm.variational_model(2, 3, 1)
    before = copy.deepcopy(m)
    x, n = sequences.padded([np.array([0, 1, 2, 0])] * 5)
    hmm.improve_posterior(m, hmm.statistics(x, n, m))
    assert m.posterior[0].sum() == pytest.approx(2 + 5) and m.posterior[2].sum() == pytest.approx(6 + 20) and m.bound > -np.inf
    assert before.posterior[2].shape == m.posterior[2].shape
