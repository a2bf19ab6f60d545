"""Exact ranks without one task for a key's rows: values are cut into bins, bins are counted, and rows are ranked in their bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 64  # of each of the two levels


def _free(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    return [n if n not in taken else f"{n}_{len(taken)}" for n in names]


def _cut(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of equal width between lo and hi, of values in rising order; -1 for null, the last for infinite ones and NaN."""
    width = F.when((hi > lo) & (hi < float("inf")) & (lo > float("-inf")), (v - lo) / (hi - lo) * bins)
    return F.when(v.isNull(), -1).when(F.isnan(v) | (v == float("inf")), bins).when(v == float("-inf"), 0).otherwise(
        F.coalesce(F.least(F.floor(width), F.lit(bins - 1)), F.lit(0))).cast("int")


def ranked(rows: DataFrame, keys: list[str], value: str, ties: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Adds rank (from 0, nulls first) by value, then ties, within the keys, and n, the keys' rows.

    A key's rows are spread over bins, so a key may hold any share of the
    table. Bins have two levels: equal widths of the value's logarithm, with
    its sign, then equal widths between the smallest and largest value of each
    of these. So neither an outlier nor values of several sizes put most rows
    into one bin; equal values always share one. The bins follow from the values
    alone, the same each time they are computed.
    """
    number = F.col(value) if not dict(rows.dtypes)[value].startswith("timestamp") else F.unix_micros(F.to_timestamp(value))
    v, u, lo, hi, a, b, base = _free(rows, "_v", "_u", "_lo", "_hi", "_a", "_b", "_base")
    x = rows.withColumn(v, number.cast("double"))
    x = x.withColumn(u, F.signum(v) * F.log1p(F.abs(v)))
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.col(u))
    span = x.groupBy(*keys).agg(F.min(finite).alias(lo), F.max(finite).alias(hi), F.count("*").alias("n"))
    x = x.join(span, keys) if keys else x.crossJoin(F.broadcast(span))  # without keys the span is one row
    x = x.withColumn(a, _cut(F.col(u), F.col(lo), F.col(hi), bins)).drop(u, lo, hi)
    inner = x.groupBy(*keys, a).agg(F.min(v).alias(lo), F.max(v).alias(hi))
    x = x.join(inner, [*keys, a]).withColumn(b, _cut(F.col(v), F.col(lo), F.col(hi), bins)).drop(v, lo, hi)
    before = W.partitionBy(*keys).orderBy(a, b).rowsBetween(W.unboundedPreceding, -1)
    counts = x.groupBy(*keys, a, b).agg(F.count("*").alias(base))  # a row for each bin
    counts = counts.select(*keys, a, b, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    own = F.row_number().over(W.partitionBy(*keys, a, b).orderBy(value, *(ties or [])))
    return x.join(counts, [*keys, a, b]).withColumn("rank", F.col(base) + own - 1).drop(a, b, base)


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles at index round(share * (n - 1)): (keys, a column for each share)."""
    x = ranked(rows.filter(F.col(value).isNotNull()).select(*keys, value), keys, value)
    at = lambda s: F.max(F.when(F.col("rank") == F.floor(F.lit(s) * (F.col("n") - 1) + 0.5), F.col(value)))
    return x.groupBy(*keys).agg(*[at(s).alias(name) for name, s in shares.items()])


def lowest(rows: DataFrame, value: str, ties: list[str], share: float) -> DataFrame:
    """Adds low: whether a row is among the share of the rows with the lowest values, one at least."""
    x = ranked(rows, [], value, ties)
    most = F.greatest(F.floor(F.col("n") * share), F.lit(1))
    return x.withColumn("low", F.col("rank") < most).drop("rank", "n")


def quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str = "quantile") -> DataFrame:
    """The share's quantile between the two nearest ranks, linearly: (keys, name)."""
    x = ranked(rows.filter(F.col(value).isNotNull()).select(*keys, value), keys, value)
    at = F.lit(share) * (F.col("n") - 1)
    low, high = F.col("rank") == F.floor(at), F.col("rank") == F.ceil(at)
    part = x.groupBy(*keys).agg(F.max(F.when(low, F.col(value))).alias("_a"), F.max(F.when(high, F.col(value))).alias("_b"), F.max(at - F.floor(at)).alias("_w"))
    return part.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(name))
