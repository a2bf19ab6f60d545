"""Attention models: gradients by differences, the fit in one place, what the model looked at."""

import math

import numpy as np
import pytest

from weftline.operators import attention as A
from weftline.operators.sequences import padded

TYPES = "service string, trace string, symbols array<string>"


def chances(seq, m):
    """Log chances after each place by a plain softmax over all earlier places: a list of (chances, weights by place)."""
    out = []
    for t in range(len(seq)):
        s = np.array([m.query[seq[t]] @ m.key[v] / math.sqrt(m.query.shape[1]) for v in seq[: t + 1]])
        w = np.exp(s - s.max())
        w /= w.sum()
        z = m.out @ sum(a * m.value[v] for a, v in zip(w, seq[: t + 1]))
        out.append((z - np.log(np.exp(z - z.max()).sum()) - z.max(), w))
    return out


def test_forward_equals_attention_over_places():
    rng = np.random.RandomState(2)
    m, seqs = A.random_attention(5, 4, 1), [rng.randint(0, 5, n) for n in (1, 2, 9, 6)]
    x, n = padded(seqs)
    per, at, likely, place, weight = A.surprises(x, n, m)
    assert (per[0], at[0], place[0]) == (0.0, -1, -1)
    for i, q in enumerate(seqs[1:], 1):
        plain = chances(q, m)
        logs = np.array([plain[t][0][q[t + 1]] for t in range(len(q) - 1)])
        assert per[i] == pytest.approx(logs.mean()) and at[i] == logs.argmin() + 1
        asked = plain[at[i] - 1]
        assert likely[i] == asked[0].argmax()
        if at[i] > 1:
            assert place[i] == np.round(asked[1][:-1], 9).argmax() and weight[i] == pytest.approx(asked[1][:-1].max(), abs=1e-8)
        else:
            assert place[i] == -1


def test_gradients_equal_differences():
    rng = np.random.RandomState(5)
    m, (x, n) = A.random_attention(4, 3, 2), padded([rng.randint(0, 4, k) for k in (7, 3, 1)])
    got, eps, at = A.gradients(x, n, m), 1e-6, 2
    for p in (m.query, m.key, m.value, m.out):
        for i in np.ndindex(p.shape):
            was = p[i]
            p[i] = was + eps
            up = A.gradients(x, n, m)[0]
            p[i] = was - eps
            down = A.gradients(x, n, m)[0]
            p[i] = was
            assert got[at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)
            at += 1
    assert at == m.numbers == len(got) and got[1] == 8


def test_memory_of_a_block_is_bounded(monkeypatch):
    rng = np.random.RandomState(5)
    m, (x, n) = A.random_attention(4, 3, 2), padded([rng.randint(0, 4, k) for k in (7, 3, 5, 5, 2)])
    whole, seen = A.gradients(x, n, m), A.surprises(x, n, m)
    monkeypatch.setattr(A, "CELLS", 8)
    np.testing.assert_allclose(A.gradients(x, n, m), whole)
    for a, b in zip(A.surprises(x, n, m), seen):
        np.testing.assert_allclose(a, b)


def test_fit_over_all_rows(spark):
    rows = [("s", f"a{i:02d}", ["up", "run", "down"] * (2 + i % 3)) for i in range(30)] + [("s", "odd", ["up", "run", "down", "up", "up", "run", "down"])]
    rows += [("t", f"b{i}", list("xyxzxyxz")) for i in range(5)] + [("few", "c", ["x", "y"])]
    got = {r.trace: r for r in A.attention_scores(spark.createDataFrame(rows, TYPES).repartition(5), "service").collect()}
    assert len(got) == 36 and "c" not in got
    for service in ("s", "t"):
        mine = [r for r in rows if r[0] == service]
        names = sorted({s for r in mine for s in r[2]})
        seqs = [np.array([names.index(s) for s in r[2]]) for r in mine]
        m, step = A.random_attention(len(names)), A.descent()
        for _ in range(A.ROUNDS):
            if not m.done:
                step(m, sum(A.gradients(*padded([q]), m) for q in seqs))
        for (_, trace, _), q in zip(mine, seqs):
            per = A.surprises(*padded([q]), m)[0][0]
            assert got[trace].per_step == pytest.approx(per, abs=1e-6)
    odd = got["odd"]
    assert (odd.surprise_at, odd.surprise, odd.expected) == (4, "up", "run") and odd.per_step < got["a00"].per_step
    assert odd.attended_at in (0, 1, 2) and 0 < odd.weight < 1
    assert got["a00"].per_step > -0.3


def test_empty_table(spark):
    assert A.attention_scores(spark.createDataFrame([], TYPES), "service").count() == 0
