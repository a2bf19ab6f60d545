"""Event sequences: trajectories, hidden Markov models, regimes, anomaly scores.

Trajectories, rates of their symbols and ranks are made by Spark over all rows,
and so are the models (hmm): the numpy fits here are for one set of sequences.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import cut
from .ranks import lowest, quantile


def trajectories(records: DataFrame, keys: list[str], ts: str, symbol: str, least: int = 4, tie: str | None = None) -> DataFrame:
    """Symbols in time order by key without consecutive repeats: (keys, symbols, times)."""
    order = [ts, *([tie] if tie else []), symbol]
    w = W.partitionBy(*keys).orderBy(*order)
    x = records.withColumn("_p", F.lag(symbol).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.col(symbol)))
    g = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
    return g.select(
        *keys, F.transform("s", lambda e: e[symbol]).alias("symbols"), F.transform("s", lambda e: e[ts]).alias("times")
    ).filter(F.size("symbols") >= least)


def bag_novelty(traj: DataFrame, service: str, common: float = 0.5, rare: float = 0.3) -> DataFrame:
    """Rarest symbols of a trajectory against how often its service's trajectories hold them."""
    t = traj.withColumn("tid", F.xxhash64("symbols", "times"))
    n = t.groupBy(service).agg(F.count("*").alias("n"))
    sym = t.select(service, "tid", F.explode(F.array_distinct("symbols")).alias("symbol"))
    rate = sym.groupBy(service, "symbol").agg(F.count("*").alias("k")).join(n, service).withColumn("rate", F.col("k") / F.col("n"))
    return rate.select(service, "symbol", F.round("rate", 6).alias("rate"), F.when(F.col("rate") >= common, "mode").when(
        F.col("rate") < rare, "novel").otherwise("ordinary").alias("kind"))


def log_likelihood(seq: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Forward recursion with scaling."""
    a, total = start * emit[:, seq[0]], 0.0
    for i in range(len(seq)):
        if i:
            a = (a @ move) * emit[:, seq[i]]
        s = a.sum()
        total += math.log(max(s, 1e-300))
        a = a / max(s, 1e-300)
    return total


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one matrix with their lengths."""
    n = np.array([len(q) for q in seqs])
    out = np.zeros((len(seqs), max(n, default=0)), np.int64)
    for i, q in enumerate(seqs):
        out[i, : len(q)] = q
    return out, n


def log_likelihoods(x: np.ndarray, n: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Of each sequence of padded(), by the scaled forward recursion."""
    return np.log(_forward(x, n, start, move, emit)[1]).sum(axis=0)


def _forward(x, n, start, move, emit):
    steps, k = x.shape[1], len(start)
    al, sc = np.zeros((steps, len(x), k)), np.ones((steps, len(x)))
    for t in range(steps):
        a = (start if not t else al[t - 1] @ move) * emit.T[x[:, t]]
        live = t < n
        sc[t] = np.where(live, np.maximum(a.sum(axis=1), 1e-300), 1)
        al[t] = np.where(live[:, None], a / sc[t][:, None], al[t - 1] if t else a)
    return al, sc


def _expected(x, n, start, move, emit):
    """Expected counts of starts, moves and emissions over all sequences, and the log likelihood."""
    al, sc = _forward(x, n, start, move, emit)
    steps, k = x.shape[1], len(start)
    be, m, e = np.ones((len(x), k)), np.zeros((k, k)), np.zeros(emit.shape)
    for t in range(steps - 1, -1, -1):
        live = t < n
        if t + 1 < steps:
            on = t + 1 < n
            ahead = emit.T[x[:, t + 1]] * be / sc[t + 1][:, None] * on[:, None]
            m += al[t].T @ ahead
            be = np.where(on[:, None], ahead @ move.T, 1)
        g = al[t] * be
        g = np.where(live[:, None], g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300), 0)
        for j in range(emit.shape[1]):
            e[:, j] += g[x[:, t] == j].sum(axis=0)
    return g.sum(axis=0), m * move, e, float(np.log(sc).sum())


def fit_hmm(seqs: list[np.ndarray], states: int, symbols: int, rounds: int = 50, seed: int = 0, prior: float = 0.0):
    """Baum-Welch; prior > 0 adds Dirichlet counts (the variational mean of a symmetric prior)."""
    rng = np.random.RandomState(seed)
    start, move, emit = (rng.dirichlet(np.ones(n), s) for n, s in ((states, 1), (states, states), (symbols, states)))
    start, last = start[0], -np.inf
    x, n = padded(seqs)
    for _ in range(rounds):
        s, m, e, ll = _expected(x, n, start, move, emit)
        s, m, e = s + prior + 1e-6, m + prior + 1e-6, e + prior + 1e-6
        start, move, emit = s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
        if abs(ll - last) < 1e-4 * max(1.0, abs(ll)):
            break
        last = ll
    return start, move, emit, ll


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (x < 6).any():
        small = x < 6
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def fit_vb_hmm(seqs: list[np.ndarray], states: int, symbols: int, rounds: int = 50, restarts: int = 3, prior: float = 1.0):
    """Variational HMM with Dirichlet priors: posterior counts and the bound, best of several starts."""
    lg = np.vectorize(math.lgamma)

    def kl(q: np.ndarray, p: float) -> float:
        s = q.sum(-1)
        return float((lg(s) - lg(q).sum(-1) - lg(np.full(s.shape, p * q.shape[-1])) + q.shape[-1] * math.lgamma(p)
                      + ((q - p) * (digamma(q) - digamma(s)[..., None])).sum(-1)).sum())

    best, (x, n) = None, padded(seqs)
    for r in range(restarts):
        rng = np.random.RandomState(r)
        qs, qm, qe = prior + rng.rand(states), prior + rng.rand(states, states), prior + rng.rand(states, symbols) * 3
        bound, last = -np.inf, -np.inf
        for _ in range(rounds):
            sub = [np.exp(digamma(q) - digamma(q.sum(-1))[..., None]) for q in (qs[None], qm, qe)]
            start, move, emit = sub[0][0], sub[1], sub[2]
            s, m, e, ll = _expected(x, n, start, move, emit)
            bound = ll - kl(qs[None], prior) - kl(qm, prior) - kl(qe, prior)
            qs, qm, qe = prior + s, prior + m, prior + e
            if abs(bound - last) < 1e-4 * max(1.0, abs(bound)):
                break
            last = bound
        if best is None or bound > best[3]:
            best = (qs, qm, qe, bound)
    return best


def choose_hmm(seqs: list[np.ndarray], symbols: int, most: int = 8):
    """The number of states from 2 to min(most, symbols) with the smallest BIC."""
    n, best = sum(map(len, seqs)), None
    for k in range(2, max(2, min(most, symbols)) + 1):
        fit = fit_hmm(seqs, k, symbols)
        free = k - 1 + k * (k - 1) + k * (symbols - 1)
        bic = -2 * fit[3] + free * math.log(max(n, 2))
        if best is None or bic < best[1]:
            best = (fit, bic, k)
    return best


def predictive(seq: np.ndarray, posterior, draws: int = 30, seed: int = 1) -> tuple[float, float]:
    """Mean and deviation of a sequence's log likelihood a step under draws of a variational posterior (qs, qm, qe)."""
    rng = np.random.RandomState(seed)
    x, n = padded([seq])
    got = []
    for _ in range(draws):
        start, move, emit = rng.dirichlet(posterior[0]), *(np.stack([rng.dirichlet(r) for r in q]) for q in posterior[1:3])
        got.append(log_likelihoods(x, n, *(np.maximum(p, 1e-12) for p in (start, move, emit)))[0] / len(seq))
    return float(np.mean(got)), float(np.std(got, ddof=1))


def calibrated_confidence(seq: np.ndarray, posterior, threshold: float, draws: int = 30, seed: int = 1) -> float:
    """Posterior probability that a sequence's log likelihood a step is below a threshold."""
    mean, sd = predictive(seq, posterior, draws, seed)
    if sd <= 1e-9:
        return float(mean < threshold)
    return 0.5 * (1 + math.erf((threshold - mean) / sd / math.sqrt(2)))


def choose_vb_hmm(seqs: list[np.ndarray], symbols: int, sizes: tuple[int, ...] = (2, 3, 4, 5)):
    """(posterior with its bound, states): the number of states with the largest bound."""
    return max(((fit_vb_hmm(seqs, k, symbols), k) for k in sizes), key=lambda f: f[0][3])


#: Least observations and symbols of a service, share of scores below a threshold, shares of rare and common
#: symbols, weight of novelty, and the floors of confidence by the rarest symbol's share.
LEAST_STEPS, LEAST_SYMBOLS, LOW_SHARE, RARE, COMMON, NOVELTY = 12, 2, 0.05, 0.3, 0.5, 2.0
FLOORS = ((0.1, 0.8), (0.2, 0.7), (1.0, 0.6))
MISSING_FLOOR = 0.5


def score_trajectories(traj: DataFrame, service: str, share: float = LOW_SHARE) -> DataFrame:
    """traj(service, trace, symbols, ...): how unusual each trajectory is.

    per_step is the log likelihood a step under the service's model (0 without
    one), novelty counts its rare and missing common symbols over the common
    ones, score = per_step - 2 * novelty. The lowest share of all trajectories,
    one at least, is anomalous. The change point is the first place of the symbol
    that is rarest in the service; confidence blends novelty and the gap to the
    service's threshold, with floors where rare symbols occur or common ones are
    missing. Models, rates and thresholds are of all rows.
    """
    from . import hmm

    kinds = dict(traj.dtypes)
    traj = cut(traj)  # read five times
    n = traj.groupBy(service).agg(F.count("*").alias("_n"))
    each = traj.select(service, "trace", F.explode(F.array_distinct("symbols")).alias("s"))
    rates = each.groupBy(service, "s").agg(F.count("*").alias("k")).join(n, service)
    rates = rates.groupBy(service).agg(F.map_from_entries(F.collect_list(F.struct("s", F.col("k") / F.col("_n")))).alias("_rates"))
    data, facts = hmm.encoded(traj, service)
    models = hmm.plain_models(data, facts)
    symbol = kinds["symbols"].removeprefix("array<").removesuffix(">")
    steps = cut(hmm.assigned(data, models, symbol).select("key", "trace", "per_step"))
    limits = quantile(steps, ["key"], "per_step", LOW_SHARE, "threshold")
    states = traj.sparkSession.createDataFrame([(k, m.states) for k, (_, m) in models.items()], "key string, states int")
    steps = steps.join(limits, "key").join(states, "key")
    x = traj.select(service, "trace", "symbols", F.col(service).cast("string").alias("key")).join(steps, ["key", "trace"], "left").join(rates, service)
    rate = lambda s: F.col("_rates")[s]
    mine = F.array_distinct("symbols")
    x = x.withColumns({"_novel": F.filter(mine, lambda s: rate(s) < RARE), "_common": F.filter(F.map_keys("_rates"), lambda s: rate(s) >= COMMON)})
    x = x.withColumn("_missing", F.size(F.array_except("_common", "symbols")))
    x = x.withColumn("novelty", (F.col("_missing") + F.size("_novel")) / F.greatest(F.lit(1), F.size("_common")))
    x = x.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("states", "int"), ("per_step", "double"), ("threshold", "double"))})
    rarest = F.array_min(F.transform("symbols", lambda s, i: F.struct(rate(s).alias("r"), i.alias("i"))))
    x = x.withColumn("_rarest", rarest).withColumn("_least", F.array_min(F.transform("_novel", rate)))
    gap = F.when(F.col("states") > 0, F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), (F.col("threshold") - F.col("per_step")) / (F.abs("threshold") + 1)))).otherwise(0.0)
    floor = F.lit(MISSING_FLOOR)
    for most, least in reversed(FLOORS):
        floor = F.when(F.col("_least") <= most, least).otherwise(floor)
    sure = 0.5 * F.least(F.lit(1.0), F.col("novelty")) + 0.5 * gap
    odd = (F.size("_novel") > 0) | (F.col("_missing") > 0)
    scored = x.select(
        service, "trace", F.size("symbols").alias("steps"), "states", "per_step", "novelty",
        (F.col("per_step") - NOVELTY * F.col("novelty")).alias("score"), F.col("_rarest.i").alias("change_at"),
        F.get("symbols", F.col("_rarest.i")).alias("change"), F.when(odd, F.greatest(sure, floor)).otherwise(sure).alias("confidence"),
    )
    return lowest(cut(scored), "score", [service, "trace"], share).withColumnRenamed("low", "anomalous")
