"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step sends every vertex's neighbours to the smallest one; the number of
steps grows with the logarithm of the longest path. Edges are cut to a written
table after each step, minima are combined before each shuffle, and joins see
one row for each vertex, so a hub with very many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b")
    return out.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    # a < b: b's smaller neighbours go to the smallest of them, and so does b
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    near = edges.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = low.select(F.col("m").alias("x"), F.col("b").alias("y"))
    out = near.unionByName(own).filter("x <> y")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges(a, b) with a < b. Gives (v, c) for each vertex but the smallest of its component."""
    now = scratch.save(edges.select("a", "b").distinct(), f"{name}0")
    i, rows = 0, now.count()
    while not now.isEmpty():
        i += 1
        now = scratch.save(_small(_large(now)), f"{name}{i}", rows)
        scratch.drop(f"{name}{i - 1}")
        if _stars(now):
            break
    return now.select(F.col("b").alias("v"), F.col("a").alias("c"))


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex is a centre or hangs on one centre only; steps keep what is connected, so that is the end."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
    each = ends.groupBy("v").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf"))
    return each.filter("centre + leaf > 1").isEmpty()
