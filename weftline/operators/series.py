"""Time series: binning, resampling, rate anomalies, and tests of causal order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.session import written


def rate_series(records: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Dense counts by (key, bin): bin = floor((at - first) / width) over ceil(range / width) + 1 bins."""
    span = records.agg(F.min(at).alias("t0"), F.max(at).alias("t1"))
    span = span.select("t0", (F.ceil((F.col("t1") - F.col("t0")) / width) + 1).cast("long").alias("bins"))
    b = F.floor((F.col(at) - F.col("t0")) / width).cast("long")
    counts = records.crossJoin(F.broadcast(span)).groupBy(key, b.alias("bin")).agg(F.count("*").alias("n"))
    grid = records.select(key).distinct().crossJoin(F.broadcast(span)).select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")
    )
    return grid.join(counts, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def resample(series: DataFrame, key: str, step: int, value: str = "n") -> DataFrame:
    """Means of step bins; a tail of fewer bins is dropped."""
    g = series.groupBy(key, F.floor(F.col("bin") / step).cast("long").alias("bin")).agg(
        F.avg(value).alias(value), F.count("*").alias("_k")
    )
    return g.filter(F.col("_k") == step).drop("_k")


def hourly_counts(records: DataFrame, key: str, ts: str) -> DataFrame:
    """Non-empty (key, day, hour) counts."""
    return records.groupBy(key, F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def mad_anomalies(hourly: DataFrame, key: str, z: float = 2.576, floor: float = 0.5) -> DataFrame:
    """Residuals from the median of (key, hour), scaled by 1.4826 MAD of the key's residuals."""
    base = hourly.groupBy(key, "hour").agg(F.median("n").alias("expected"))
    x = hourly.join(base, [key, "hour"]).withColumn("r", F.col("n") - F.col("expected"))
    mid = x.groupBy(key).agg(F.median("r").alias("m"))
    x = x.join(mid, key)
    mad = x.groupBy(key).agg(F.median(F.abs(F.col("r") - F.col("m"))).alias("mad"))
    x = x.join(mad, key).withColumn(
        "z", F.round((F.col("r") - F.col("m")) / F.greatest(1.4826 * F.col("mad"), F.lit(floor)), 6)
    )
    return x.filter(F.abs("z") >= z).select(key, "day", "hour", "n", "expected", "z")


def trailing_baseline(hourly: DataFrame, key: str, size: int = 30, least: int = 3) -> DataFrame:
    """Each count against the median of up to size earlier counts of its (key, hour); null below least."""
    w = W.partitionBy(key, "hour").orderBy("day").rowsBetween(-size, -1)
    past = F.array_sort(F.collect_list("n").over(w))
    k = F.size(past)
    mid = F.when(k >= least, F.when(k % 2 == 1, F.get(past, (k / 2).cast("int")).cast("double")).otherwise(
        (F.get(past, (k / 2).cast("int") - 1) + F.get(past, (k / 2).cast("int"))) / 2
    ))
    return hourly.withColumn("baseline", mid)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * h / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def granger(x: np.ndarray, y: np.ndarray, lags: int = 5, least: int = 24) -> float:
    """Smallest p over lags of the F-test that x's past adds to y's own; 1 for short or flat series."""
    n, best = len(y), 1.0
    if n < least or np.ptp(x) == 0 or np.ptp(y) == 0:
        return best
    for k in range(1, lags + 1):
        rows = n - k
        own = np.column_stack([np.ones(rows), *[y[k - j : n - j] for j in range(1, k + 1)]])
        full = np.column_stack([own, *[x[k - j : n - j] for j in range(1, k + 1)]])
        df = rows - full.shape[1]
        if df <= 0:
            continue
        rss = [float(((y[k:] - m @ np.linalg.lstsq(m, y[k:], rcond=None)[0]) ** 2).sum()) for m in (own, full)]
        if rss[1] <= 1e-12:
            best = min(best, 0.0 if rss[0] > 1e-9 else 1.0)
            continue
        best = min(best, f_tail((rss[0] - rss[1]) / k / (rss[1] / df), k, df))
    return best


def _bins(x: np.ndarray, bins: int) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return np.zeros(len(x), int) if hi == lo else np.minimum(((x - lo) / (hi - lo) * bins).astype(int), bins - 1)


def transfer_entropy(x: np.ndarray, y: np.ndarray, bins: int = 4) -> float:
    """Bits that x's last value adds about y's next beyond y's last."""
    bx, by = _bins(x, bins), _bins(y, bins)
    joint = np.zeros((bins, bins, bins))
    np.add.at(joint, (by[1:], by[:-1], bx[:-1]), 1)
    p = joint / joint.sum()
    a, b, c = p.sum(axis=0), p.sum(axis=2), p.sum(axis=(0, 2))
    i, j, k = np.nonzero(p)
    v = p[i, j, k]
    return float((v * np.log2(v * c[j] / (a[j, k] * b[i, j]))).sum())


def transfer_entropy_z(x: np.ndarray, y: np.ndarray, rounds: int = 100, seed: int = 42) -> float:
    """Transfer entropy against shuffled x, in standard deviations."""
    rng = np.random.RandomState(seed)
    base = np.array([transfer_entropy(rng.permutation(x), y) for _ in range(rounds)])
    sd = base.std()
    return float((transfer_entropy(x, y) - base.mean()) / sd) if sd > 1e-12 else 0.0


#: Bytes of all series that are broadcast, at most.
SERIES_BYTES = 1 << 26


def causal_tests(series: DataFrame, key: str, edges: DataFrame, value: str = "n", every: bool = True) -> DataFrame:
    """For edges(src, dst): Granger's p and the transfer entropy's z of src on dst.

    A series has a row for each bin and is one array. Series of bounded size are
    broadcast, and the edges of one target are tested at once, then those of one
    source; larger ones meet each edge in a join. Unless ``every``, z is null
    where Granger's test decides.
    """
    packed = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", value))).alias("s")).select(
        key, F.transform("s", lambda p: p[value].cast("double")).alias("s")
    )
    x = edges.select("src", "dst").distinct()
    size = packed.agg(F.count("*").alias("n"), F.min(F.size("s")).alias("least"), F.max(F.size("s")).alias("most"), F.max(F.array_max(
        F.transform("s", lambda v: F.when((v != F.floor(v)) | (v < 0), F.lit(1e18)).otherwise(v)))).alias("top")).first()
    kind = next((k for k in (np.uint8, np.uint16) if size.n and size.top is not None and size.top <= np.iinfo(k).max), np.float64)
    if size.n and size.least == size.most and size.n * size.most * np.dtype(kind).itemsize <= SERIES_BYTES:
        return _tested_together(packed, key, x, kind, every)
    for k in ("src", "dst"):
        x = x.join(packed.select(F.col(key).alias(k), F.col("s").alias(f"s_{k}")), k)

    def run(batches):
        for pdf in batches:
            a = [np.asarray(v, float) for v in pdf["s_src"]]
            b = [np.asarray(v, float) for v in pdf["s_dst"]]
            yield pd.DataFrame({
                "src": pdf["src"], "dst": pdf["dst"],
                "granger_p": [granger(p, q) for p, q in zip(a, b, strict=True)],
                "te_z": [transfer_entropy_z(p, q) for p, q in zip(a, b, strict=True)],
            })

    kind = dict(edges.dtypes)
    spread = x.repartition(x.sparkSession.sparkContext.defaultParallelism, "src", "dst")
    return spread.mapInPandas(run, f"src {kind['src']}, dst {kind['dst']}, granger_p double, te_z double")


_series: dict = {}  # that this worker tests


def _tested_together(packed: DataFrame, key: str, edges: DataFrame, kind: type, every: bool) -> DataFrame:
    """causal_tests() where all series fit a broadcast: no edge meets a series in a shuffle."""
    spark, types = edges.sparkSession, dict(edges.dtypes)
    names, rows = [], []
    for r in packed.toLocalIterator():
        names.append(r[key])
        rows.append(np.array(r["s"], float).astype(kind))
    shared = spark.sparkContext.broadcast((names, np.array(rows)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    both = f"src {types['src']}, dst {types['dst']}, granger_p double"

    def loaded(what: str):
        from . import causal_pairs as C

        names, rows = shared.value
        if "ids" not in _series or _series["rows"] is not rows:
            _series.clear()
            _series.update(rows=rows, ids={x: i for i, x in enumerate(names)})
        if what not in _series:
            _series[what] = C.Lagged(rows) if what == "lagged" else C.Shuffled(rows)
        return _series["ids"], _series[what]

    def at_once(batches, one: str):
        # rows come in the order of one side; what is held is one key's edges, and a key of many in parts
        held = None
        for pdf in batches:
            held = pdf if held is None or not len(held) else pd.concat([held, pdf])
            whole = held[one].to_numpy() != held[one].iloc[-1] if len(held) < 1 << 14 else np.ones(len(held), bool)
            if whole.any():
                yield held[whole]
                held = held[~whole]
        if held is not None and len(held):
            yield held

    def by_target(batches):
        for pdf in at_once(batches, "dst"):
            ids, test = loaded("lagged")
            p = pdf.groupby("dst", sort=False)["src"].transform(lambda s: test.granger(np.array([ids[v] for v in s]), ids[pdf.at[s.index[0], "dst"]]))
            yield pdf.assign(granger_p=p.astype(float))

    def by_source(batches):
        for pdf in at_once(batches, "src"):
            ids, test = loaded("shuffled")
            z = pdf.groupby("src", sort=False)["dst"].transform(lambda s: test.z(ids[pdf.at[s.index[0], "src"]], np.array([ids[v] for v in s])))
            yield pdf.assign(te_z=z.astype(float))

    known = _spread(edges, parts, "dst").mapInPandas(_numbered(by_target), both)
    if every:
        return _spread(known, parts, "src").mapInPandas(_numbered(by_source), f"{both}, te_z double")
    known = written(known, "granger")  # read twice
    decided = F.col("granger_p") < GRANGER_P
    open_ = _spread(known.filter(~decided), parts, "src").mapInPandas(_numbered(by_source), f"{both}, te_z double")
    return known.filter(decided).withColumn("te_z", F.lit(None).cast("double")).unionByName(open_)


def _spread(edges: DataFrame, parts: int, one: str) -> DataFrame:
    return edges.repartition(parts, one).sortWithinPartitions(one)


def _numbered(run):
    """run over batches whose rows are numbered through."""
    def numbered(batches):
        n = 0
        for pdf in batches:
            pdf.index = range(n, n + len(pdf))
            n += len(pdf)
            if len(pdf):
                yield pdf

    return lambda batches: run(numbered(batches))


#: What a causal edge needs.
GRANGER_P, TE_Z = 0.05, 2.0


def causal_gate(edges: DataFrame, tests: DataFrame, least_pmi: float = 2.0, least_lead: float = 0.7) -> DataFrame:
    """edges(src, dst, pmi, lead) that a test supports, Granger's first, else transfer entropy: adds via and confidence."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    via = F.when(F.col("granger_p") < GRANGER_P, "granger").when(F.col("te_z") > TE_Z, "transfer-entropy")
    x = edges.filter((F.col("pmi") >= least_pmi) & (F.col("lead") >= least_lead)).join(tests, ["src", "dst"])
    x = x.withColumn("via", via).filter("via is not null")
    stat = F.when(F.col("via") == "granger", 1 - F.col("granger_p") / GRANGER_P).otherwise(F.col("te_z") / (2 * TE_Z))
    conf = 0.4 * clip((F.col("pmi") - 2) / 8) + 0.3 * clip((F.col("lead") - 0.7) / 0.3) + 0.3 * clip(stat)
    return x.withColumn("confidence", F.round(clip(conf), 6))


def correlations(series: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Pearson correlation of each pair of keys over their bins: (a, b, r, n)."""
    x = series.select("bin", F.col(key).alias("a"), F.col(value).cast("double").alias("x"))
    y = series.select("bin", F.col(key).alias("b"), F.col(value).cast("double").alias("y"))
    return x.join(y, "bin").filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def merge_sources(sources: dict[str, DataFrame], width: float) -> DataFrame:
    """Series of several sources on one grid of bins: (node, bin, n), the node being source:key.

    Each source has rows (key, at, value): a bin is the mean of its values, or the
    number of its rows where values are null; empty bins are 0.
    """
    rows = None
    for name, df in sources.items():
        x = df.select(F.concat(F.lit(f"{name}:"), "key").alias("node"), F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("value"))
        rows = x if rows is None else rows.unionByName(x)
    span = rows.agg(F.min("at").alias("t0"), F.max("at").alias("t1"))  # one row
    span = span.select("t0", (F.floor((F.col("t1") - F.col("t0")) / width) + 1).cast("long").alias("bins"))
    binned = rows.crossJoin(F.broadcast(span)).groupBy("node", F.floor((F.col("at") - F.col("t0")) / width).cast("long").alias("bin")).agg(
        F.coalesce(F.avg("value"), F.count("*").cast("double")).alias("n"))
    grid = rows.select("node").distinct().crossJoin(F.broadcast(span)).select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return grid.join(binned, ["node", "bin"], "left").select("node", "bin", F.coalesce("n", F.lit(0.0)).alias("n"))


#: Fixed value: an impulse below this is over.
SMALLEST = 1e-4


def impulses(events: DataFrame, key: str, at: str, width: float, half_life: float, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Point events as impulses of 1 that halve every half_life seconds, by bin: (key, bin, n) where it isn't 0.

    An impulse goes on until it is below SMALLEST or the series ends, and events outside start .. stop count in the
    first or last bin. Without a half-life it is one bin. Bins begin at start (the first event by default).
    """
    lo, hi = F.min(at).alias("_lo"), F.max(at).alias("_hi")
    span = events.agg(lo, hi).select(F.coalesce(F.lit(start), "_lo").alias("_t0"), F.coalesce(F.lit(stop), "_hi").alias("_t1"))
    x = events.select(key, at).crossJoin(F.broadcast(span))  # one row
    bins = F.greatest(F.lit(1), F.floor((F.col("_t1") - F.col("_t0")) / width) + 1)
    first = F.least(bins - 1, F.greatest(F.lit(0), F.floor((F.col(at) - F.col("_t0")) / width)))
    x = x.select(key, first.cast("long").alias("first"), bins.cast("long").alias("bins")).groupBy(key, "first", "bins").agg(F.count("*").alias("_k"))
    if not half_life:
        return x.groupBy(key, F.col("first").alias("bin")).agg(F.sum("_k").cast("double").alias("n"))
    decay = math.exp(-width * math.log(2) / half_life)
    # the bin in which it falls below SMALLEST is the first without it
    long = math.floor(math.log(SMALLEST) / math.log(decay)) + 1
    x = x.withColumn("bin", F.explode(F.sequence("first", F.least(F.col("bins") - 1, F.col("first") + long - 1))))
    return x.groupBy(key, "bin").agg(F.sum(F.col("_k") * F.pow(F.lit(decay), F.col("bin") - F.col("first"))).alias("n"))
