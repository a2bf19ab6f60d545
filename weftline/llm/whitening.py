"""Whitening of embeddings from covariances that are merged pair by pair.

Each partition computes a count, a local mean and the scatter around that mean;
two such triples merge by the pairwise formula

    n = a.n + b.n, d = b.mean - a.mean
    mean = a.mean + d * b.n / n, scatter = a.scatter + b.scatter + outer(d, d) * a.n * b.n / n

and a treeReduce merges all of them, so that no task or driver holds more than a
few triples of d * d doubles. The driver decomposes the covariance (its size is
that of the dimensions, not of the rows). A second pass whitens every row and
merges the covariance of the result in the same way: its largest departure from
the identity is ``identity_error``. A third pass returns the rows.

Entries become whole numbers floor(64 * c) + 1000000. Means and scatter are
taken of what lies above 1000000, which leaves covariances as they are and
keeps the digits; sums are of whole numbers.

Edge cases: vectors that are null, empty or hold null or non-finite entries
take no part, and neither do vectors of another length than the commonest (of
equally common ones the longest): one odd row must not stop the others. Rows
that repeat an id are rows of their own, null ids too. A component whose
eigenvalue is 0 up to rounding (fewer rows than dimensions, constant or repeated
dimensions) has a null ``whitened`` and takes no part in ``identity_error``.
With fewer dimensions than ``components`` there are as many as dimensions. An
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the whole numbers that stand for entries.
SCALE, SHIFT = 64, 1_000_000
#: An eigenvalue below this share of the largest one is rounding.
RANK = 1e-12
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Count, mean and centred scatter of some rows; exact sums where the rows are whole numbers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n = len(x)
        mean = x.sum(axis=0) / n
        d = x - mean
        left = d.sum(axis=0)  # what rounding of the mean leaves
        return cls(n, mean, d.T @ d - np.outer(left, left) / n, np.array([int(s) for s in x.sum(axis=0)], object))

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        d = other.mean - self.mean
        share = other.n / n
        return Moments(
            n, self.mean + d * share, self.scatter + other.scatter + np.outer(d, d) * (self.n * share), self.sums + other.sums,
        )


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Pairwise merge; None is a partition without rows."""
    return b if a is None else a if b is None else a.merge(b)


def whole(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    """A column of vectors as rows of whole numbers above SHIFT, in doubles."""
    c = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * c).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length; 0 if there are none."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(ok)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = first.d if first else 0
    return rows.filter(F.size("v") == d), d


def moments(rows: DataFrame, width: int, weights: np.ndarray | None = None, at: np.ndarray | None = None, depth: int = 2) -> Moments | None:
    """Moments of all rows of rows(v), by treeReduce; with ``at`` and ``weights`` of (x - at) @ weights instead."""
    import pickle

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                x = whole(batch, 0, width)
                held = merged(held, Moments.of(x if weights is None else (x - at) @ weights))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["m"])

    parts = rows.select("v").mapInArrow(local, "m binary").rdd.map(lambda r: pickle.loads(bytes(r.m)))
    return parts.treeReduce(merged, depth) if parts.getNumPartitions() else None


@dataclass
class Whitener:
    """mean and components of the whole numbers (above SHIFT); ``weights`` maps centred rows to whitened ones."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    weights: np.ndarray
    live: np.ndarray

    @classmethod
    def fit(cls, m: Moments, components: int) -> Whitener:
        cov = m.scatter / m.n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(cov))
        values, vectors = values[order], vectors[:, order]
        live = values > RANK * max(float(values[0]), np.finfo(float).tiny)
        scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
        explained = np.where(live, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
        return cls(m.n, m.sums, np.array([float(s) for s in m.sums]) / m.n, values, explained, vectors * scale, live)

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """Sum over dimensions of (n * x - S)^2, exact: in 64 bits where that is enough."""
        top = self.n * (int(np.abs(x).max(initial=0)) + 1) + int(max((abs(s) for s in self.sums), default=0))
        if top * top * x.shape[1] < 1 << 62:
            d = self.n * x.astype(np.int64) - self.sums.astype(np.int64)
            return [Decimal(int(v)) for v in (d * d).sum(axis=1)]
        return [Decimal(sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True))) for row in x]


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors(id, vector) -> one row for each vector and component.

    vec_id, component (from 1, by falling eigenvalue), n, deviation (exact),
    whitened, explained (share of the trace), identity_error (of all rows).
    """
    spark = vectors.sparkSession
    rows, width = usable(vectors, id_col, vector_col)
    fit = moments(rows, width) if width else None
    if fit is None:
        return spark.createDataFrame([], OUT)
    w = Whitener.fit(fit, components)
    check = moments(rows, width, w.weights[:, w.live], w.mean)
    live = int(w.live.sum())
    error = float(np.abs(check.scatter / check.n - np.eye(live)).max()) if live else 0.0
    k = len(w.values)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = whole(batch, 1, width)
            y = (x - w.mean) @ w.weights
            each = np.repeat(np.arange(n), k)
            exact = pa.array(w.deviations(x), pa.decimal128(38, 0))
            dead = np.tile(~w.live, n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, w.n, np.int64)), exact.take(pa.array(each)), pa.array(y.ravel(), mask=dead),
                pa.array(np.tile(w.explained, n)), pa.array(np.full(n * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, OUT)


def whiten_digest(vectors: DataFrame) -> DataFrame:
    """whiten with deviation as a long (null where it needs more than 64 bits)."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as long)"))
