"""Models on grouped data: Gaussian processes, template embeddings, the review ranker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def _near(d: np.ndarray, scale: float = 6.0, period: float = 24.0) -> np.ndarray:
    """Covariance of two hours by their distance."""
    return np.exp(-2 * np.sin(np.pi * d / period) ** 2) + 0.25 * np.exp(-0.5 * (d / (scale * 8)) ** 2)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _near(np.abs(a[:, None] - b[None, :]))


#: Points up to which the covariance is one matrix; on more whole hours it is only ever multiplied with.
DIRECT = 1_024
EXACT = 1e-10  # relative residual of the iterative solution


def gp_baseline(x: np.ndarray, y: np.ndarray, at: np.ndarray, noise: float = 0.1, direct: int = DIRECT) -> np.ndarray:
    """Mean of a Gaussian process with a daily and a smooth part.

    On more than ``direct`` points that are all whole hours the system is solved on
    the grid: memory is linear in the hours spanned, time is theirs times their
    logarithm for each step, and the steps depend on the kernel and the noise.
    """
    m, s = y.mean(), max(y.std(), 1e-9)
    z = (y - m) / s
    if len(x) > direct and (x == np.floor(x)).all() and (at == np.floor(at)).all():
        return m + s * _on_grid(x.astype(np.int64), z, at.astype(np.int64), noise)
    k = _kernel(x, x) + noise * np.eye(len(x))
    return m + s * (_kernel(at, x) @ np.linalg.solve(k, z))


def _on_grid(x: np.ndarray, z: np.ndarray, at: np.ndarray, noise: float) -> np.ndarray:
    """The same by conjugate gradients: a stationary kernel on a regular grid is multiplied as a circle, by its spectrum.

    Hours without a value take no part, an hour with two values counts with both.
    """
    first = min(x.min(), at.min())
    x, at = x - first, at - first
    hours = int(max(x.max(), at.max())) + 1
    size = 1 << (2 * hours - 1).bit_length()
    row = np.zeros(size)
    row[:hours] = _near(np.arange(hours))
    row[size - hours + 1 :] = row[hours - 1 : 0 : -1]
    spectrum = np.fft.rfft(row)
    spread = lambda v: np.fft.irfft(spectrum * np.fft.rfft(np.bincount(x, v, hours), size), size)
    a, r = np.zeros(len(x)), z.copy()
    p, rr = r.copy(), float(r @ r)
    goal = EXACT**2 * rr
    for _ in range(10 * len(x)):  # in exact arithmetic len(x) are enough
        if rr <= goal:
            break
        q = spread(p)[x] + noise * p
        step = rr / float(p @ q)
        a, r = a + step * p, r - step * q
        rr, last = float(r @ r), rr
        p = r + rr / last * p
    return spread(a)[at]


def sparse_gp(x: np.ndarray, y: np.ndarray, at: np.ndarray, inducing: int = 24, noise: float = 0.1) -> np.ndarray:
    """The same through inducing points at quantiles of x: cost n m^2."""
    z = np.unique(np.quantile(x, np.linspace(0, 1, min(inducing, len(x)))))
    m, s = y.mean(), max(y.std(), 1e-9)
    kzz, kzx = _kernel(z, z) + 1e-6 * np.eye(len(z)), _kernel(z, x)
    w = np.linalg.solve(noise * kzz + kzx @ kzx.T, kzx @ ((y - m) / s))
    return m + s * (_kernel(at, z) @ w)


def gp_rates(hourly: DataFrame, key: str, least: int = 12, hours: int = 4, inducing: int | None = None) -> DataFrame:
    """Expected count and MAD z of each hourly count under its key's process; keys with too few points have nulls.

    The process is the full one for any number of points, on a key's hours in one task: beyond DIRECT points in memory
    that is linear in the hours it spans. Only with ``inducing`` it is the sparse one, of so many points.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "hour"])
        out = pdf[[key, "day", "hour", "n"]].copy()
        if len(pdf) < least or pdf["hour"].nunique() < hours:
            return out.assign(expected=None, z=None)
        t = (pd.to_datetime(pdf["day"]).astype("int64") // 3_600_000_000_000).to_numpy(float) + pdf["hour"].to_numpy(float)
        t, y = t - t[0], pdf["n"].to_numpy(float)
        fit = gp_baseline(t, y, t) if inducing is None else sparse_gp(t, y, t, inducing)
        r = y - fit
        mad = max(1.4826 * np.median(np.abs(r - np.median(r))), 0.5)
        return out.assign(expected=fit, z=(r - np.median(r)) / mad)

    kind = dict(hourly.dtypes)[key]
    x = hourly.withColumn("day", F.col("day").cast("timestamp"))
    return x.groupBy(key).applyInPandas(run, f"{key} {kind}, day timestamp, hour int, n long, expected double, z double")


#: Columns beyond k that the iteration carries, the most rounds, and how little the variances move at its end (relative).
SPARE, PCA_ROUNDS, PCA_MOVE = 8, 40, 1e-6


def template_vectors(templates: DataFrame, k: int = 12, rounds: int = PCA_ROUNDS) -> DataFrame:
    """Bags of words projected on the k directions of most variance and scaled to length 1 (zeros without a word): adds v.

    All words take part, whatever their number: the directions are found by
    subspace iteration, in which a round is two joins of (template, word, count)
    with one row of k + SPARE numbers for each word or template. Only sums of
    products of these columns come to the driver. With fewer words than k there are as
    many directions as words. Each row is its own, so repeated templates stay.
    """
    x = cut(templates.withColumn("_id", F.monotonically_increasing_id()))
    cells = x.select("_id", F.explode(F.regexp_extract_all(F.lower("template"), F.lit(r"[a-z_]{2,}"), 0)).alias("_word"))
    cells = cut(cells.groupBy("_id", "_word").agg(F.count("*").cast("double").alias("_c")))
    total = x.count()
    words = cells.groupBy("_word").agg((F.sum("_c") / total).alias("_mean"))
    wide = min(k + SPARE, words.count())
    if not wide:
        return templates.withColumn("v", F.array().cast("array<double>"))
    ys, zs = [f"_y{i}" for i in range(wide)], [f"_z{i}" for i in range(wide)]
    # any start will do that is the same each time
    v = cut(words.select("_word", "_mean", *[(F.xxhash64("_word", F.lit(i)) / F.lit(2.0**63)).alias(z) for i, z in enumerate(zs)]))
    v, last = cut(_turned(v, zs, zs, _whitened(_products(v, zs)))), None
    for turns in range(1, rounds + 1):
        y = cut(_projected(cells, v, zs, ys))
        # centred: what the mean bag has is taken off each template, those without words included
        mean = np.array(v.agg(*[F.sum(F.col("_mean") * F.col(z)) for z in zs]).first(), float)
        inner = _products(y, ys) - total * np.outer(mean, mean)
        variance, turn = np.linalg.eigh(inner)
        variance, turn = variance[::-1], turn[:, ::-1]
        settled = last is not None and (np.abs(variance - last)[:k] <= PCA_MOVE * variance[0]).all()
        # without any variance (one bag of words) each direction is as good
        if settled or turns == rounds or variance[0] <= 1e-9 * (1 + total * mean @ mean):
            break
        last = variance
        back = cells.join(y, "_id").groupBy("_word").agg(*[F.sum(F.col("_c") * F.col(c)).alias(c) for c in ys])
        # the sum of (count - mean) * (y - its mean) over templates
        z = back.join(v.select("_word", "_mean"), "_word").select(
            "_word", "_mean", *[(F.col(c) - total * F.col("_mean") * float(m)).alias(d) for c, d, m in zip(ys, zs, mean, strict=True)])
        z = cut(z)  # read for its products and again
        v = cut(_turned(z, zs, zs, _whitened(_products(z, zs))))
    most = [f"_p{i}" for i in range(min(k, wide))]
    p = _projected(cells, _turned(v, zs, most, turn[:, : len(most)]), most, most)
    size = F.sqrt(sum(F.col(c) * F.col(c) for c in most))
    unit = F.array(*[F.when(size > 0, F.col(c) / size).otherwise(0.0) for c in most])
    none = F.array(*[F.lit(0.0)] * len(most))
    return x.join(p.select("_id", unit.alias("v")), "_id", "left").select(*templates.columns, F.coalesce("v", none).alias("v"))


def _products(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all pairs of columns."""
    n = len(columns)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    got = rows.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"{i}_{j}") for i, j in at]).first()
    out = np.zeros((n, n))
    for (i, j), g in zip(at, got, strict=True):
        out[i, j] = out[j, i] = g or 0.0
    return out


def _whitened(products: np.ndarray) -> np.ndarray:
    """Turns columns with these products into orthonormal ones; directions without length become zeros."""
    size, turn = np.linalg.eigh(products)
    ok = size > 1e-12 * max(size.max(), 1e-300)
    return turn * np.where(ok, 1 / np.sqrt(np.where(ok, size, 1)), 0)


def _turned(rows: DataFrame, columns: list[str], names: list[str], turn: np.ndarray) -> DataFrame:
    made = [sum(F.col(c) * float(t) for c, t in zip(columns, turn[:, i], strict=True)).alias(n) for i, n in enumerate(names)]
    return rows.select(*[c for c in rows.columns if c not in columns], *made)


def _projected(cells: DataFrame, v: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """(_id, names): each template's counts times the rows of its words."""
    return cells.join(v.select("_word", *columns), "_word").groupBy("_id").agg(
        *[F.sum(F.col("_c") * F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)])


def nearest_templates(vectors: DataFrame, most: float = 0.25, block: int = 10_000) -> DataFrame:
    """Pairs of the catalogue at a cosine distance of most at the most: (a, b, distance); one side comes in blocks of bounded size."""
    from weftline.functions.vector import dot

    blocks = vectors.count() // block + 1
    a = vectors.select(F.col("template").alias("a"), F.col("v").alias("va"))
    b = vectors.select(F.col("template").alias("b"), F.col("v").alias("vb"), F.pmod(F.xxhash64("template"), F.lit(blocks)).alias("_block"))
    found = None
    for i in range(blocks):
        x = a.join(F.broadcast(b.filter(F.col("_block") == i)), F.col("a") < F.col("b"))
        x = x.withColumn("distance", 1 - dot(F.col("va"), F.col("vb"))).filter(F.col("distance") <= most).select("a", "b", "distance")
        found = x if found is None else found.unionByName(x)
    return found


#: The numeric features of a proposal.
RANKER_FEATURES = (
    "confidence_score", "evidence_volume", "evidence_recency", "cross_domain", "consistency_risk", "title_token_count", "age_seconds", "regime_id",
)


def ranker_features(proposals: DataFrame, now: str) -> DataFrame:
    """proposals(title, created_at, .. and the scores) with RANKER_FEATURES as doubles; what is missing or no number is null."""
    have = set(proposals.columns)
    number = lambda c: F.col(c).cast("string").try_cast("double") if c in have else F.lit(None).cast("double")
    made = F.try_to_timestamp(F.regexp_replace(F.split_part(F.col("created_at").cast("string"), F.lit("."), F.lit(1)), "T", " "))
    age = (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(made)) / F.lit(1e6)
    words = F.size(F.filter(F.split(F.coalesce("title", F.lit("")), r"\s+"), lambda w: w != "")).cast("double")
    special = {"title_token_count": words, "age_seconds": F.when(age.isNotNull(), F.greatest(age, F.lit(0.0)))}
    return proposals.withColumns({c: special[c] if c in special else number(c) for c in RANKER_FEATURES})


def review_ranker(decisions: DataFrame, numeric: list[str], kind: str, label: str = "approved", least: int = 20):
    """Fitted pipeline (median impute, scale, one-hot, balanced logistic), or None with fewer decisions or one outcome."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    # a feature that no decision has says nothing, and can't be imputed
    numeric = [c for c, k in decisions.agg(*[F.count(c).alias(c) for c in numeric]).first().asDict().items() if k]
    n = decisions.groupBy(label).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in n)
    if total < least or len(n) < 2:
        return None
    weight = F.lit(0.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], total / (2 * r["n"])).otherwise(weight)
    filled = [f"{c}_f" for c in numeric]
    x = decisions.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    stages = [
        Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_num"),
        StandardScaler(withMean=True, inputCol="_num", outputCol="_std"), StringIndexer(inputCol=kind, outputCol="_k", handleInvalid="keep"),
        OneHotEncoder(inputCol="_k", outputCol="_hot"), VectorAssembler(inputCols=["_std", "_hot"], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-3),
    ]
    return Pipeline(stages=stages).fit(x)
