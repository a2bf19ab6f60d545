"""Online operators on Structured Streaming: rate detector, regimes, sessions, windows.

State is keyed, so it spreads over the cluster and recovers from its
checkpoint; rows later than the watermark are dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RATE_OUT = (
    "cluster string, hour int, day date, n long, expected double, sd double, z double, is_anomaly boolean, direction string, via string"
)


class RateDetector(StatefulProcessor):
    """Scores a (cluster, hour)'s count against the median and MAD of its last 30, then appends it.

    A refitted baseline (columns mu and sd of the rows, where given) takes their
    place. A count is an anomaly from 3 earlier ones on; the scale is 0.5 at least.
    """

    SIZE, WARM, FLOOR, SCALE, LEAST_Z = 30, 3, 0.5, 1.4826, 2.576

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "counts string")

    def baseline(self, past: list[int]) -> tuple[float, float]:
        if not past:
            return 0.0, self.FLOOR
        mid = float(np.median(past))
        return mid, max(self.SCALE * float(np.median(np.abs(np.array(past) - mid))), self.FLOOR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = json.loads(self.past.get()[0]) if self.past.exists() else []
        new = pd.concat(list(rows)).sort_values("day")
        out = []
        for r in new.itertuples():
            fitted = getattr(r, "mu", None) is not None and not pd.isna(r.mu)
            mid, sd = (float(r.mu), max(float(r.sd), self.FLOOR)) if fitted else self.baseline(past)
            z = (r.n - mid) / sd
            odd = abs(z) >= self.LEAST_Z and len(past) >= self.WARM
            way = ("spike" if z > 0 else "dip") if odd else "normal"
            out.append((key[0], int(key[1]), r.day, int(r.n), mid, sd, z, odd, way, "gp" if fitted else "median_mad"))
            past = (past + [int(r.n)])[-self.SIZE :]
        self.past.update((json.dumps(past),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RATE_OUT.split(", ")])

    def close(self) -> None:
        pass


def hourly_stream(events: DataFrame, ts: str, key: str, late: str = "2 hours") -> DataFrame:
    """Closed hourly counts of a stream by key: (cluster, day, hour, n)."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = x.groupBy(F.window("_t", "1 hour").alias("w"), F.col(key).alias("cluster")).agg(F.count("*").alias("n"))
    return g.select("cluster", F.to_date("w.start").alias("day"), F.hour("w.start").alias("hour"), "n")


def detect_rates(hourly: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """The detector over a stream of hourly counts, with refitted baselines(cluster, hour, mu, sd) where there are any."""
    if baselines is not None:
        hourly = hourly.join(baselines.select("cluster", "hour", "mu", "sd"), ["cluster", "hour"], "left")
    return hourly.groupBy("cluster", "hour").transformWithStateInPandas(
        RateDetector(), outputStructType=RATE_OUT, outputMode="Update", timeMode="None"
    )


def refit(hourly: DataFrame, least: int = 4, noise: float = 0.1) -> DataFrame:
    """Baselines of each cluster and hour of day by a daily Gaussian process over its last counts: (cluster, hour, mu, sd).

    Only each hour's last 30 counts take part, as their number, mean and spread;
    clusters with fewer than ``least`` counts have no baseline.
    """
    last = W.partitionBy("cluster", "hour").orderBy(F.desc("day"))
    some = hourly.withColumn("k", F.row_number().over(last)).filter(F.col("k") <= RateDetector.SIZE)
    each = some.groupBy("cluster", "hour").agg(
        F.count("*").alias("k"), F.sum(F.col("n").cast("double")).alias("s"), F.sum(F.col("n") * F.col("n").cast("double")).alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["k"].to_numpy(float)
        if k.sum() < least:
            return pd.DataFrame(columns=["cluster", "hour", "mu", "sd"])
        mean = pdf["s"].sum() / k.sum()
        scale = max(float(np.sqrt(max(pdf["q"].sum() / k.sum() - mean**2, 0))), 1e-9)
        x, y, every = pdf["hour"].to_numpy(float), (pdf["s"] / pdf["k"] - mean).to_numpy() / scale, np.arange(24.0)
        kernel = lambda a, b: np.exp(-2 * np.sin(np.pi * np.abs(a[:, None] - b) / 24) ** 2)
        solve = np.linalg.solve(kernel(x, x) + np.diag(noise / k), np.column_stack([y, kernel(x, every)]))
        mu = kernel(every, x) @ solve[:, 0]
        var = 1 - (kernel(every, x).T * solve[:, 1:]).sum(axis=0) + noise
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "hour": np.arange(24), "mu": mean + scale * mu,
                             "sd": scale * np.sqrt(np.maximum(var, 0))})

    return each.groupBy("cluster").applyInPandas(run, "cluster string, hour int, mu double, sd double")


class RegimeAssigner(StatefulProcessor):
    """Assigns a service's trajectories to frozen regimes by likelihood and online mixing weights (with decay)."""

    def __init__(self, models: dict[str, np.ndarray], symbols: list[str], decay: float = 1.0):
        self.models, self.at, self.decay = models, {s: i for i, s in enumerate(symbols)}, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alpha = handle.getValueState("alpha", "a string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from weftline.operators.sequences import digamma

        names = sorted(self.models)
        alpha = np.array(json.loads(self.alpha.get()[0])) if self.alpha.exists() else np.ones(len(names))
        out = []
        for pdf in rows:
            for trace, symbols in zip(pdf["trace"], pdf["symbols"], strict=True):
                seq = [self.at[s] for s in symbols if s in self.at]
                prev = [len(self.at), *seq[:-1]]
                logp = np.array([self.models[m][prev, seq].sum() if seq else 0.0 for m in names])
                logp = logp + digamma(alpha) - digamma(np.array([alpha.sum()]))
                r = np.exp(logp - logp.max())
                r /= r.sum()
                alpha = 1 + (alpha - 1) * self.decay + r
                out.append((key[0], trace, names[int(r.argmax())], float(r.max())))
        self.alpha.update((json.dumps(alpha.tolist()),))
        yield pd.DataFrame(out, columns=["service", "trace", "regime", "share"])

    def close(self) -> None:
        pass


def assign_regimes(traj: DataFrame, models: dict[str, np.ndarray], symbols: list[str], decay: float = 1.0) -> DataFrame:
    """traj(service, trace, symbols) as a stream -> (service, trace, regime, share)."""
    return traj.groupBy("service").transformWithStateInPandas(
        RegimeAssigner(models, symbols, decay), outputStructType="service string, trace string, regime string, share double",
        outputMode="Update", timeMode="None",
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key by gaps: (key, start, stop, n); works on streams and tables."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        x = x.withWatermark("_t", late)
    g = x.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def consolidate(stream: DataFrame, path: str, checkpoint: str, fit=refit):
    """A periodic refit over all that has arrived: each available batch is appended to path/seen, then the fit of all is
    written to path/fit-<number>; a batch that is repeated after a failure replaces its own files."""
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        fit(df.sparkSession.read.parquet(f"{path}/seen")).write.mode("overwrite").parquet(f"{path}/fit-{number:09d}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confidence(z: float) -> float:
    """Two-sided normal tail of a score."""
    return math.erfc(abs(z) / math.sqrt(2))
