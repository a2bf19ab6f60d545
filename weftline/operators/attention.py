"""Next-symbol models by attention, fitted over all rows.

A symbol asks, by its query, the keys of all symbols up to itself; their values,
weighted by the answers, give the chances of the next symbol. Weights depend on
symbols alone, so a step needs how often each symbol has come, not the places:
a trajectory costs its length times the alphabet, however long it is.

Training is full gradients in rounds, as hidden Markov models are fitted (hmm):
tasks send one sum of gradients for each service, the driver makes a step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hmm import CELLS, _by_key, blocks, encoded, fit, in_groups

DIM, ROUNDS, RATE, TOLERANCE = 12, 40, 0.1, 1e-4
MEANS, SQUARES = 0.9, 0.99  # of the moving gradients


@dataclass
class Attention:
    """query, key, value and out have a row for each symbol."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    loss: float = np.inf  # mean of a step, before the last change
    done: bool = False

    @property
    def numbers(self) -> int:
        return 2 + 4 * self.query.size

    @property
    def scale(self) -> float:
        return 1 / math.sqrt(self.query.shape[1])


def random_attention(symbols: int, dim: int = DIM, seed: int = 0) -> Attention:
    rng = np.random.RandomState(seed)
    return Attention(*(rng.normal(0, 1 / math.sqrt(dim), (symbols, dim)) for _ in range(4)))


def forward(x: np.ndarray, n: np.ndarray, m: Attention) -> Iterator[tuple]:
    """For each place but the last: (place, rows that go on, how often they have seen each symbol, weights, context, log chances)."""
    seen = np.zeros((len(x), len(m.query)))
    for t in range(x.shape[1] - 1):
        rows = np.flatnonzero(n > t + 1)
        seen[rows, x[rows, t]] += 1
        s = np.where(seen[rows] > 0, m.query[x[rows, t]] @ m.key.T * m.scale, -np.inf)
        w = seen[rows] * np.exp(s - s.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        c = w @ m.value
        z = c @ m.out.T
        z -= z.max(axis=1, keepdims=True)
        yield t, rows, seen[rows], w, c, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _parts(x: np.ndarray, n: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Rows of a block, as many at once as bounded memory for rows times symbols allows."""
    most = max(1, CELLS // symbols)
    for at in range(0, len(x), most):
        yield x[at : at + most], n[at : at + most], slice(at, at + most)


def gradients(x: np.ndarray, n: np.ndarray, m: Attention) -> np.ndarray:
    """One vector: summed loss, steps, and the gradient of the loss by query, key, value and out."""
    loss, steps = 0.0, 0
    query, key, value, out = (np.zeros(m.query.shape) for _ in range(4))
    for some, lengths, _ in _parts(x, n, len(m.query)):
        for t, rows, _, w, c, chance in forward(some, lengths, m):
            here, after, each = some[rows, t], some[rows, t + 1], np.arange(len(rows))
            loss -= chance[each, after].sum()
            steps += len(rows)
            g = np.exp(chance)
            g[each, after] -= 1
            out += g.T @ c
            back = g @ m.out
            value += w.T @ back
            dw = back @ m.value.T
            ds = w * (dw - (w * dw).sum(axis=1, keepdims=True)) * m.scale
            key += ds.T @ m.query[here]
            np.add.at(query, here, ds @ m.key)
    return np.concatenate([[loss, steps], query.ravel(), key.ravel(), value.ravel(), out.ravel()])


def descent(rate: float = RATE, tolerance: float = TOLERANCE) -> Callable[[Attention, np.ndarray], None]:
    """A step along the mean gradient over its moving size; a model is done when its loss moves less than tolerance (relative)."""
    moving: dict[int, list] = {}

    def step(m: Attention, v: np.ndarray) -> None:
        steps = max(v[1], 1.0)
        loss, g = v[0] / steps, v[2:] / steps
        m.done = abs(loss - m.loss) < tolerance * max(1.0, abs(loss))
        m.loss = loss
        if m.done:
            return
        at = moving.setdefault(id(m), [0, np.zeros(g.shape), np.zeros(g.shape)])
        at[0] += 1
        at[1] = MEANS * at[1] + (1 - MEANS) * g
        at[2] = SQUARES * at[2] + (1 - SQUARES) * g * g
        move = rate * (at[1] / (1 - MEANS ** at[0])) / (np.sqrt(at[2] / (1 - SQUARES ** at[0])) + 1e-8)
        for p, d in zip((m.query, m.key, m.value, m.out), np.split(move, 4), strict=True):
            p -= d.reshape(p.shape)

    return step


def surprises(x: np.ndarray, n: np.ndarray, m: Attention) -> tuple[np.ndarray, ...]:
    """By row: mean log chance of a step (0 without one); place of the least likely symbol (-1 without one), the symbol that
    was likeliest there; the earlier place that weighed most in that (-1 without one), and its weight."""
    total, least = np.zeros(len(x)), np.full(len(x), np.inf)
    at, likely, place, weight = (np.full(len(x), -1, int), np.full(len(x), -1, int), np.full(len(x), -1, int), np.zeros(len(x)))
    for some, lengths, part in _parts(x, n, len(m.query)):
        share = np.zeros((len(some), len(m.query)))  # of one place with the symbol, where the least likely one was expected
        for t, rows, seen, w, _, chance in forward(some, lengths, m):
            p = chance[np.arange(len(rows)), some[rows, t + 1]]
            total[part][rows] += p
            low = np.round(p, 9) < least[part][rows]
            hit = rows[low]
            least[part][hit], at[part][hit], likely[part][hit] = np.round(p[low], 9), t + 1, np.round(chance[low], 9).argmax(axis=1)
            share[hit] = w[low] / np.maximum(seen[low], 1)
        # the place before the surprise is the one that asks
        past = np.where(np.arange(some.shape[1]) < at[part][:, None] - 1, np.round(np.take_along_axis(share, some, axis=1), 9), -1)
        best = past.argmax(axis=1)
        top = past[np.arange(len(some)), best]
        place[part], weight[part] = np.where(top >= 0, best, -1), np.maximum(top, 0)
    return total / np.maximum(n - 1, 1), at, likely, place, weight


def attention_models(data: DataFrame, facts: DataFrame, dim: int = DIM, rounds: int = ROUNDS, seed: int = 0) -> dict[str, tuple[list, Attention]]:
    """key -> (alphabet, model) for keys with enough steps and symbols."""
    out = {}
    for mine, alphabets, models in in_groups(facts, lambda a: [random_attention(a, dim, seed)], 4 * dim):
        fit(data.filter(mine), models, rounds, descent(), gradients)
        out |= {k: (alphabets[k], c[0]) for k, c in models.items()}
    return out


def attention_scores(traj: DataFrame, service: str, **settings) -> DataFrame:
    """traj(service, trace, symbols): each trajectory under its service's model, with what the model looked at.

    per_step is the mean log chance of the next symbol, 0 for a single symbol.
    surprise_at is the place of the least likely symbol, expected what was likeliest
    there, attended_at the earlier place that weighed most (the first of equals,
    null where only one symbol came before). Services with too few steps or symbols
    are left out. An empty table gives no row.
    """
    data, facts = encoded(traj, service)
    shared = data.sparkSession.sparkContext.broadcast(attention_models(data, facts, **settings))
    kinds = dict(data.dtypes)
    symbol = dict(traj.dtypes)["symbols"].removeprefix("array<").removesuffix(">")
    names = ["key", "trace", "per_step", "surprise_at", "surprise", "expected", "attended_at", "attended", "weight"]
    schema = f"key string, trace {kinds['trace']}, per_step double, surprise_at int, surprise {symbol}, expected {symbol}, attended_at int, attended {symbol}, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, seqs, rows in _by_key(batches, shared.value, 2):
            alphabet, m = shared.value[key]
            for some, x, n in blocks(seqs):
                per, at, likely, place, weight = surprises(x, n, m)
                one = lambda p, v: [None if a < 0 else v(i, a) for i, a in enumerate(p.tolist())]
                named = lambda i, a: alphabet[x[i, a]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(some)), pa.array([rows[i][0] for i in some]), pa.array(per), pa.array(one(at, lambda i, a: a), pa.int32()),
                    pa.array(one(at, named)), pa.array(one(likely, lambda i, a: alphabet[a])), pa.array(one(place, lambda i, a: a), pa.int32()),
                    pa.array(one(place, named)), pa.array(one(place, lambda i, a: float(weight[i])), pa.float64()),
                ], names=names)

    return data.select("key", "seq", "trace").mapInArrow(run, schema).withColumnRenamed("key", service)
