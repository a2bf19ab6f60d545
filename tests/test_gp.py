"""The process on a grid of hours: the same as the direct solution, in linear memory."""

import time

import numpy as np
import pytest

from weftline.operators import models


def counts(hours, seed=3, gaps=0.2):
    rng = np.random.RandomState(seed)
    x = np.flatnonzero(rng.rand(hours) >= gaps).astype(float)
    return x, 30 + 12 * np.sin(2 * np.pi * x / 24) + 0.01 * x + rng.normal(0, 3, len(x))


@pytest.mark.parametrize("hours, gaps", [(48, 0.0), (500, 0.3), (1_500, 0.2), (2_500, 0.9)])
def test_grid_equals_the_direct_solution(hours, gaps):
    x, y = counts(hours, gaps=gaps)
    at = np.arange(hours + 5, dtype=float)
    plain = models.gp_baseline(x, y, at, direct=len(x))
    np.testing.assert_allclose(models.gp_baseline(x, y, at, direct=1), plain, atol=1e-6)


def test_grid_with_repeated_hours_equal_values_and_late_origins():
    x, y = counts(300)
    twice = np.concatenate([x, x[:40]])
    other = np.concatenate([y, y[:40] + 5])
    np.testing.assert_allclose(models.gp_baseline(twice, other, x, direct=1), models.gp_baseline(twice, other, x), atol=1e-6)
    flat = np.full(len(x), 7.0)
    np.testing.assert_allclose(models.gp_baseline(x, flat, x, direct=1), flat)
    late = x + 480_000
    np.testing.assert_allclose(models.gp_baseline(late, y, late, direct=1), models.gp_baseline(x, y, x), atol=1e-6)


def test_points_between_hours_are_solved_directly():
    x, y = counts(100)
    half = x + 0.5
    np.testing.assert_allclose(models.gp_baseline(half, y, half, direct=1), models.gp_baseline(x, y, x), atol=1e-8)


def test_ten_years_of_one_key(spark):
    """87,600 hours would take a matrix of 61 GB."""
    from pyspark.sql import functions as F

    hours = 87_600
    day = F.date_add(F.lit("2014-01-01").cast("date"), (F.col("id") / 24).cast("int"))
    n = (F.lit(50) + F.round(20 * F.sin(F.col("id") * 3.141592653589793 / 12))).cast("long")
    x = spark.range(hours).select(
        F.lit("hot").alias("cluster"), day.alias("day"), (F.col("id") % 24).cast("int").alias("hour"),
        F.when(F.col("id") == 50_000, 900).otherwise(n).cast("long").alias("n"))
    began = time.perf_counter()
    far = models.gp_rates(x, "cluster").orderBy(F.desc(F.abs("z"))).first()
    assert (far.n, far.day.year) == (900, 2019) and far.z > 100
    assert time.perf_counter() - began < 120
