"""Hidden Markov models of trajectories, fitted over all rows.

A model is a mixture of K regimes, each a hidden Markov model with S states; a
plain model has one regime. Expectation runs where the rows are: each task goes
through its trajectories in blocks of bounded size and sends expected counts,
one vector for each key and candidate; Spark adds them up, and the sums, which
are as large as the models, come to the driver for the next parameters. All
candidates (numbers of regimes or states, restarts) of all keys share a pass.

Models travel by broadcast. Keys are dealt into groups whose candidates have
MODEL_BYTES at most, and groups are fitted one after the other; the chosen models
of all keys stay on the driver, at most GROUPS times as much (an error beyond).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .ranks import quantile, ranked
from .sequences import LEAST_STEPS, LEAST_SYMBOLS, LOW_SHARE, digamma, padded

#: Fixed values of the regime mixture: most regimes, restarts, states of a regime, least trajectories of a key and of a regime, prior.
REGIMES, RESTARTS, STATES, LEAST_OF_KEY, LEAST_OF_REGIME, PRIOR = 5, 3, 2, 4, 2, 1.0
#: Fixed values of the two-level model: penalty of a trajectory without a model, least probability of a symbol.
MISSING, FLOOR = -1e3, 1e-12
ROUNDS, TOLERANCE, SMOOTH = 30, 1e-4, 1e-6
MODEL_BYTES, GROUPS = 64 << 20, 16
CELLS = 100_000  # places of padded trajectories in a block
DRAWS = 32


@dataclass
class Model:
    """start (K, S), move (K, S, S), emit (K, S, A); log_mix (K) are the expected logarithms of the regimes' weights."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_mix: np.ndarray
    bound: float = -np.inf
    sizes: np.ndarray | None = None  # trajectories by likeliest regime
    posterior: tuple | None = None  # counts of a variational fit
    done: bool = False

    @property
    def regimes(self) -> int:
        return len(self.log_mix)

    @property
    def states(self) -> int:
        return self.start.shape[1]

    @property
    def numbers(self) -> int:
        """Length of its statistics."""
        return 2 + 2 * self.regimes + self.start.size + self.move.size + self.emit.size


def forward(x: np.ndarray, n: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values (T, K, rows, S) and scales (T, K, rows) of padded sequences under each regime."""
    steps, rows, k, s = x.shape[1], len(x), m.regimes, m.states
    al, sc = np.zeros((steps, k, rows, s)), np.ones((steps, k, rows))
    emit = m.emit.transpose(2, 0, 1)  # (A, K, S)
    for t in range(steps):
        a = (m.start[:, None, :] if not t else al[t - 1] @ m.move) * emit[x[:, t]].transpose(1, 0, 2)
        live = t < n
        sc[t] = np.where(live, np.maximum(a.sum(axis=2), 1e-300), 1)
        al[t] = np.where(live[:, None], a / sc[t][:, :, None], al[t - 1] if t else a)
    return al, sc


def log_likelihoods(x: np.ndarray, n: np.ndarray, m: Model) -> np.ndarray:
    """(K, rows)"""
    return np.log(forward(x, n, m)[1]).sum(axis=0)


def responsibilities(ll: np.ndarray, m: Model) -> np.ndarray:
    z = m.log_mix[:, None] + ll
    z = np.exp(z - z.max(axis=0))
    return z / z.sum(axis=0)


def statistics(x: np.ndarray, n: np.ndarray, m: Model) -> np.ndarray:
    """What the next model needs, one vector: weighted log likelihood, entropy, weights and counts by regime, expected counts."""
    al, sc = forward(x, n, m)
    ll = np.log(sc).sum(axis=0)
    r = responsibilities(ll, m)
    steps, k, s = x.shape[1], m.regimes, m.states
    be, move, emit = np.ones((k, len(x), s)), np.zeros((k, s, s)), np.zeros((m.emit.shape[2], k, s))
    table = m.emit.transpose(2, 0, 1)
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            on = (t + 1 < n)[None, :, None]
            ahead = table[x[:, t + 1]].transpose(1, 0, 2) * be / sc[t + 1][:, :, None] * on
            move += (al[t] * r[:, :, None]).transpose(0, 2, 1) @ ahead
            be = np.where(on, ahead @ m.move.transpose(0, 2, 1), 1)
        g = al[t] * be
        g = np.where((t < n)[None, :, None], g / np.maximum(g.sum(axis=2, keepdims=True), 1e-300), 0) * r[:, :, None]
        np.add.at(emit, x[:, t], g.transpose(1, 0, 2))
    hard = np.bincount(r.argmax(axis=0), minlength=k)
    entropy = -(r * np.log(np.where(r > 0, r, 1))).sum()
    return np.concatenate([[(r * ll).sum(), entropy], r.sum(axis=1), hard, g.sum(axis=1).ravel(), (move * m.move).ravel(),
                           emit.transpose(1, 2, 0).ravel()])


def split(v: np.ndarray, m: Model) -> tuple:
    k, s, a = m.regimes, m.states, m.emit.shape[2]
    cuts = np.cumsum([2, k, k, k * s, k * s * s])
    head, r, hard, start, move, emit = np.split(v, cuts)
    return head[0], head[1], r, hard, start.reshape(k, s), move.reshape(k, s, s), emit.reshape(k, s, a)


def blocks(seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in seqs, padded, lengths), of like lengths together."""
    order = np.argsort([len(q) for q in seqs], kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(seqs[order[at + n]]) <= CELLS:
            n += 1
        some = order[at : at + n]
        yield some, *padded([seqs[i] for i in some])
        at += n


def encoded(traj: DataFrame, key: str, *carry: str) -> tuple[DataFrame, DataFrame]:
    """(key, trace, carried columns, seq): symbols as places in the key's sorted alphabet; and (key, alphabet, n, steps). Both written."""
    t = traj.withColumn("key", F.col(key).cast("string"))
    each = t.select("key", F.explode("symbols").alias("s")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("alphabet"))
    facts = cut(t.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("symbols")).alias("steps")).join(each, "key"))
    places = F.map_from_arrays("alphabet", F.sequence(F.lit(0), F.size("alphabet") - 1))
    data = t.join(facts.select("key", places.alias("_at")), "key")
    seq = F.transform("symbols", lambda s: F.col("_at")[s])
    return cut(data.select("key", "trace", *carry, seq.alias("seq"))), facts


def expect(data: DataFrame, models: dict[str, list], counts: Callable = statistics) -> dict[tuple[str, int], np.ndarray]:
    """Sums of counts(padded, lengths, model) over all rows of data(key, seq) for the candidates of each key that aren't done."""
    live = {k: [(i, m) for i, m in enumerate(c) if not m.done] for k, c in models.items()}
    shared = data.sparkSession.sparkContext.broadcast({k: c for k, c in live.items() if c})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for key, seqs, _ in _by_key(batches, shared.value):
            for _, x, n in blocks(seqs):
                for i, m in shared.value[key]:
                    sums[key, i] = sums.get((key, i), 0) + counts(x, n, m)
        for (key, i), v in sums.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(some), pa.string()), pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(v[some])],
                names=["key", "c", "at", "v"],
            )

    rows = data.select("key", "seq").mapInArrow(run, "key string, c int, at int, v double").groupBy("key", "c", "at").agg(F.sum("v").alias("v"))
    out = {(k, i): np.zeros(m.numbers) for k, c in live.items() for i, m in c}
    got = rows.toPandas()  # as many numbers as the models have
    for (k, i), g in got.groupby(["key", "c"]):
        out[k, i][g["at"].to_numpy()] = g["v"].to_numpy()
    return out


def _by_key(batches: Iterator[pa.RecordBatch], known, *carry: int) -> Iterator[tuple[str, list[np.ndarray], list]]:
    """(key, sequences, their rows' carried values) of each batch's keys that are known; seq is the batch's second column."""
    for batch in batches:
        keys, seqs = batch.column(0).to_pylist(), batch.column(1)
        extra = [batch.column(i).to_pylist() for i in carry]
        rows: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            if k in known:
                rows.setdefault(k, []).append(i)
        for k, at in rows.items():
            yield k, [np.asarray(seqs[i].values.to_numpy(), np.int64) for i in at], [tuple(e[i] for e in extra) for i in at]


def improve(m: Model, v: np.ndarray, tolerance: float = TOLERANCE) -> None:
    """Next parameters of a mixture, its bound and whether it moved less than tolerance (relative)."""
    rl, entropy, r, hard, start, move, emit = split(v, m)
    norm = lambda c: (c + SMOOTH) / (c + SMOOTH).sum(axis=-1, keepdims=True)
    alpha = PRIOR + r
    log_mix = digamma(alpha) - digamma(np.array([alpha.sum()]))
    bound = rl + entropy + float((r * log_mix).sum()) if m.regimes > 1 else rl
    m.done = abs(bound - m.bound) < tolerance * max(1.0, abs(bound))
    m.start, m.move, m.emit, m.log_mix, m.bound, m.sizes = norm(start), norm(move), norm(emit), log_mix if m.regimes > 1 else np.zeros(1), bound, hard


def random_model(regimes: int, states: int, symbols: int, seed: int) -> Model:
    rng = np.random.RandomState(seed)
    draw = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return Model(draw(regimes, states), draw(regimes, states, states), draw(regimes, states, symbols), np.full(regimes, -math.log(regimes)))


def fit(
    data: DataFrame, models: dict[str, list], rounds: int = ROUNDS, step: Callable[[Model, np.ndarray], None] = improve, counts: Callable = statistics,
) -> None:
    """Rounds of expectation and new parameters until no candidate moves; models change in place."""
    for _ in range(rounds):
        for (k, i), v in expect(data, models, counts).items():
            step(models[k][i], v)
        if all(m.done for c in models.values() for m in c):
            break


def in_groups(facts: DataFrame, start: Callable[[int], list], fields: int) -> Iterator[tuple[DataFrame, dict, dict]]:
    """(filter for the data, alphabets, first models) of groups of keys with MODEL_BYTES of models at most; fields is what a symbol costs."""
    ok = facts.filter((F.size("alphabet") >= LEAST_SYMBOLS) & (F.col("steps") >= LEAST_STEPS))
    cost = ok.agg(F.sum((F.size("alphabet") + 8) * fields * 8)).first()[0] or 0
    groups = int(cost // MODEL_BYTES) + 1
    if groups > GROUPS:
        raise ValueError(f"models of {cost} bytes; fit fewer keys at once")
    of = F.pmod(F.xxhash64("key"), F.lit(groups))
    for g in range(groups):
        alphabets = {r.key: r.alphabet for r in ok.filter(of == g).collect()}
        if alphabets:
            yield of == g, alphabets, {k: start(len(a)) for k, a in alphabets.items()}


def best_mixture(candidates: list[Model]) -> Model:
    """The candidate with the greatest bound whose regimes all have LEAST_OF_REGIME trajectories."""
    fair = [m for m in candidates if m.regimes == 1 or m.sizes.min() >= LEAST_OF_REGIME]
    return max(fair, key=lambda m: m.bound)


def mixtures(symbols: int, most: int, restarts: int) -> list[Model]:
    return [random_model(k, min(STATES, symbols), symbols, 42 + 13 * r) for k in range(1, most + 1) for r in range(restarts if k > 1 else 1)]


def fit_mixtures(data: DataFrame, facts: DataFrame, most: int = REGIMES, restarts: int = RESTARTS, rounds: int = ROUNDS) -> dict[str, tuple[list, Model]]:
    """key -> (alphabet, mixture) for keys with LEAST_OF_KEY trajectories and enough steps and symbols."""
    out = {}
    fields = sum(m.regimes * m.states for m in mixtures(4, most, restarts))
    for mine, alphabets, models in in_groups(facts.filter(F.col("n") >= LEAST_OF_KEY), lambda a: mixtures(a, most, restarts), fields):
        fit(data.filter(mine), models, rounds)
        out |= {k: (alphabets[k], best_mixture(c)) for k, c in models.items()}
    return out


def assigned(data: DataFrame, models: dict[str, tuple[list, Model]], kind: str) -> DataFrame:
    """(key, trace, regime, regimes, posterior, per_step, change_at, change) for trajectories of keys with a model."""
    shared = data.sparkSession.sparkContext.broadcast(models)
    names = ["key", "trace", "regime", "regimes", "posterior", "per_step", "change_at", "change"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, seqs, rows in _by_key(batches, shared.value, 2):
            alphabet, m = shared.value[key]
            likely = np.log(np.maximum(m.emit.max(axis=1), FLOOR))  # (K, A)
            for some, x, n in blocks(seqs):
                ll = log_likelihoods(x, n, m)
                r = responsibilities(ll, m)
                z = r.argmax(axis=0)
                each = np.arange(len(some))
                change = np.where(np.arange(x.shape[1]) < n[:, None], likely[z[:, None], x], np.inf).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(some)), pa.array([rows[i][0] for i in some]), pa.array(z.astype(np.int32)), pa.array(np.full(len(some), m.regimes, np.int32)),
                    pa.array(r[z, each]), pa.array(ll[z, each] / n), pa.array(change.astype(np.int32)), pa.array([alphabet[x[i, change[i]]] for i in each]),
                ], names=names)

    trace = dict(data.dtypes)["trace"]
    return data.select("key", "seq", "trace").mapInArrow(
        run, f"key string, trace {trace}, regime int, regimes int, posterior double, per_step double, change_at int, change {kind}")


def regime_anomalies(traj: DataFrame, service: str, share: float = LOW_SHARE, **settings) -> DataFrame:
    """traj(service, trace, symbols): every trajectory with its regime, judged by that regime's own threshold.

    threshold is the share's quantile of the steps' log likelihood among the
    trajectories of the regime; a trajectory below it is anomalous, with
    confidence 1 / (1 + exp(per_step - threshold)), and null otherwise. The
    change point is the first place of the symbol that the regime's states emit
    least. Services with too few trajectories, steps or symbols are left out.
    """
    kind = dict(traj.dtypes)["symbols"].removeprefix("array<").removesuffix(">")
    data, facts = encoded(traj, service)
    got = cut(assigned(data, fit_mixtures(data, facts, **settings), kind))
    limits = quantile(got, ["key", "regime"], "per_step", share, "threshold")
    low = F.col("per_step") < F.col("threshold")
    out = got.join(limits, ["key", "regime"]).withColumn("anomalous", low).withColumn(
        "confidence", F.when(low, 1 / (1 + F.exp(F.col("per_step") - F.col("threshold")))))
    return out.withColumnRenamed("key", service)


def two_levels(
    traj: DataFrame, service: str, at: str, levels: int = 3, windows: int = 8, most_rounds: int = 10, **settings,
) -> tuple[DataFrame, dict, int]:
    """traj(service, trace, symbols, at): regimes of time that all services share, over regimes of each service.

    The trajectories of a service, in the order of ``at``, are cut into windows of
    equal numbers; each window has one of ``levels`` global regimes. In turns,
    each service gets a mixture for each global regime, from the trajectories of
    its windows, and each window the global regime under which its trajectories
    are likeliest (the best regime of each counts, MISSING without a model),
    until no window changes. Windows begin in blocks of time. Returns (window,
    global_regime, services, log_likelihood), models by "global|service", rounds.
    """
    spark, n_of = traj.sparkSession, F.floor(F.col("rank") * windows / F.col("n"))
    placed = ranked(traj, [service], at, ["trace"]).withColumn("window", F.least(F.lit(windows - 1), n_of).cast("int"))
    data, facts = encoded(placed, service, "window")
    z = [min(levels - 1, i * levels // windows) for i in range(windows)]
    services = {r.window: sorted(r.s) for r in data.groupBy("window").agg(F.collect_set("key").alias("s")).collect()}
    for turn in range(1, most_rounds + 1):
        of = F.element_at(F.array(*map(F.lit, z)), F.col("window") + 1)
        now = data.withColumn("key", F.concat_ws("|", of.cast("string"), "key"))
        part = now.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("seq")).alias("steps"))
        named = facts.select(F.col("key").alias("service"), "alphabet")
        part = part.withColumn("service", F.substring_index("key", "|", -1)).join(named, "service").drop("service")
        models = fit_mixtures(now, cut(part), **settings)
        scores = window_scores(data, models, levels, windows)
        new = [int(s.argmax()) for s in scores]
        if new == z:
            break
        z = new
    rows = [(w, z[w], services.get(w, []), float(scores[w, z[w]])) for w in range(windows)]
    return spark.createDataFrame(rows, "window int, global_regime int, services array<string>, log_likelihood double"), models, turn


def window_scores(data: DataFrame, models: dict[str, tuple[list, Model]], levels: int, windows: int) -> np.ndarray:
    """(windows, levels): summed log likelihood of a window's trajectories under each global regime."""
    shared = data.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((windows, levels))
        for batch in batches:
            every = set(batch.column(0).to_pylist())
            for key, seqs, rows in _by_key(iter([batch]), every, 2):
                at = np.array([r[0] for r in rows])
                for some, x, n in blocks(seqs):
                    for level in range(levels):
                        m = shared.value.get(f"{level}|{key}")
                        np.add.at(sums[:, level], at[some], MISSING if m is None else log_likelihoods(x, n, m[1]).max(axis=0))
        w, g = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(w.ravel().astype(np.int32)), pa.array(g.ravel().astype(np.int32)), pa.array(sums.ravel())], names=["w", "g", "v"])

    rows = data.select("key", "seq", "window").mapInArrow(run, "w int, g int, v double").groupBy("w", "g").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((windows, levels))
    for r in rows:
        out[r.w, r.g] = r.v
    return out


def _dirichlet_kl(q: np.ndarray) -> float:
    """Of counts q from a symmetric prior, over all rows."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    s = q.sum(-1)
    prior = math.lgamma(PRIOR * q.shape[-1]) - q.shape[-1] * math.lgamma(PRIOR)
    return float((lg(s) - lg(q).sum(-1) - prior + ((q - PRIOR) * (digamma(q) - digamma(s)[..., None])).sum(-1)).sum())


def _expected_logs(q: tuple) -> list[np.ndarray]:
    return [np.exp(digamma(p) - digamma(p.sum(-1))[..., None]) for p in q]


def improve_posterior(m: Model, v: np.ndarray, tolerance: float = TOLERANCE) -> None:
    """Next posterior counts of a variational model and its bound."""
    rl, _, _, _, start, move, emit = split(v, m)
    bound = rl - sum(map(_dirichlet_kl, m.posterior))
    m.done = abs(bound - m.bound) < tolerance * max(1.0, abs(bound))
    m.bound = bound
    if not m.done:
        m.posterior = tuple(PRIOR + c for c in (start, move, emit))
        m.start, m.move, m.emit = _expected_logs(m.posterior)


def variational_model(states: int, symbols: int, seed: int) -> Model:
    rng = np.random.RandomState(seed)
    q = (PRIOR + rng.rand(1, states), PRIOR + rng.rand(1, states, states), PRIOR + 3 * rng.rand(1, states, symbols))
    return Model(*_expected_logs(q), np.zeros(1), posterior=q)


def drawn(m: Model, draws: int, seed: int) -> Model:
    """Draws from a variational posterior, as the regimes of one model."""
    rng = np.random.RandomState(seed)
    one = lambda q: np.stack([rng.dirichlet(r) for r in q.reshape(-1, q.shape[-1])]).reshape(q.shape[1:])
    sets = [[one(q) for q in m.posterior] for _ in range(draws)]
    return Model(*(np.maximum(np.stack(p), FLOOR) for p in zip(*sets, strict=True)), np.full(draws, -math.log(draws)))


def variational_confidence(
    traj: DataFrame, service: str, share: float = LOW_SHARE, sizes: tuple[int, ...] = (2, 3, 4, 5), restarts: int = RESTARTS, rounds: int = ROUNDS,
    draws: int = DRAWS, seed: int = 1,
) -> DataFrame:
    """traj(service, trace, symbols): how sure it is that a trajectory lies below its service's threshold.

    Each service's variational model (the number of states with the greatest bound) gives ``draws``
    of its parameters; a trajectory's mean and deviation of the log likelihood a step under these give the
    probability that it is below the share's quantile of the means. Services with too few steps or symbols
    are left out.
    """
    data, facts = encoded(traj, service)
    found = {}
    start = lambda a: [variational_model(k, a, 17 * r + 11) for k in sizes for r in range(restarts)]
    for mine, _, models in in_groups(facts, start, sum(sizes) * restarts + max(sizes) * draws):
        fit(data.filter(mine), models, rounds, improve_posterior)
        best = {k: max(c, key=lambda m: m.bound) for k, c in models.items()}
        found |= {k: (m.states, drawn(m, draws, seed)) for k, m in best.items()}
    shared = data.sparkSession.sparkContext.broadcast(found)
    trace = dict(data.dtypes)["trace"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, seqs, rows in _by_key(batches, shared.value, 2):
            states, m = shared.value[key]
            for some, x, n in blocks(seqs):
                step = log_likelihoods(x, n, m) / n
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(some)), pa.array([rows[i][0] for i in some]), pa.array(np.full(len(some), states, np.int32)),
                    pa.array(step.mean(axis=0)), pa.array(step.std(axis=0, ddof=1)),
                ], names=["key", "trace", "states", "per_step", "deviation"])

    got = cut(data.select("key", "seq", "trace").mapInArrow(run, f"key string, trace {trace}, states int, per_step double, deviation double"))
    got = got.join(quantile(got, ["key"], "per_step", share, "threshold"), "key")
    sharp = (F.col("per_step") < F.col("threshold")).cast("double")
    z = (F.col("threshold") - F.col("per_step")) / F.col("deviation")
    return got.withColumn("confidence", F.when(F.col("deviation") <= 1e-9, sharp).otherwise(normal_share(z))).withColumnRenamed("key", service)


def normal_share(z):
    """The standard normal distribution's share below z (Arrow batches: SQL has no error function)."""
    @F.pandas_udf("double")
    def share(v: pd.Series) -> pd.Series:
        return pd.Series([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in v], dtype="float64")

    return share(z)


def plain_models(data: DataFrame, facts: DataFrame, most_states: int = 8, rounds: int = 50) -> dict[str, tuple[list, Model]]:
    """key -> (alphabet, model): one regime, the number of states from 2 to most_states (and the symbols) with the smallest BIC."""
    steps = F.col("steps")
    out = {}
    sizes = lambda a: range(2, max(2, min(most_states, a)) + 1)
    for mine, alphabets, models in in_groups(facts, lambda a: [random_model(1, k, a, 0) for k in sizes(a)], sum(range(2, most_states + 1))):
        some = data.filter(mine)
        fit(some, models, rounds)
        n = {r.key: r.steps for r in facts.filter(mine).select("key", steps).collect()}
        bic = lambda k, m: -2 * m.bound + (m.states**2 - 1 + m.states * (m.emit.shape[2] - 1)) * math.log(max(n[k], 2))
        out |= {k: (alphabets[k], min(c, key=lambda m: bic(k, m))) for k, c in models.items()}
    return out
