"""Causal graph search (PC) where the series are: no matrix of all pairs leaves Spark.

Level 0 is a product of blocks of series; only pairs that stay dependent become
edges. In each further level a node's task holds the series of its neighbours
and tests its edges given sets of them, those that are neighbours of both ends
first; a node with very many sets is dealt out by its edges. Neighbours are as
they were when the level began, so the result depends on no order, and edges
are removed between levels. Orientation is joins over the edges that are left.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .causal_graph import independence
from .graph import cut

BLOCK = 256  # series of a block
TESTS = 200_000  # that a part of a node's edges takes on
APART = "u string, v string, given array<string>"


def vectors(series: DataFrame, key: str, at: str = "bin", value: str = "n") -> DataFrame:
    """(k, x): each series in order, centred and of length 1 (zeros if it is flat)."""
    g = series.groupBy(F.col(key).cast("string").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(value).cast("double").alias("y")))).alias("s"))
    y = F.transform("s", lambda p: p["y"])
    mean = F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y")
    g = g.select("k", y.alias("y")).withColumn("x", F.transform("y", lambda v: v - mean))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    # what rounding leaves of a flat series isn't variance
    flat = size <= 1e-9 * F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v))
    return g.withColumn("_size", size).select("k", F.transform("x", lambda v: F.when(flat, F.lit(0.0)).otherwise(v / F.col("_size"))).alias("x"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def dependent(x: DataFrame, n: int, alpha: float) -> DataFrame:
    """(u, v), u < v: pairs of series that are dependent given nothing, by products of blocks."""
    blocks = -(-x.count() // BLOCK) or 1
    own = x.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    each = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    left = own.withColumn("c", F.explode(F.filter(each, lambda c: c >= F.col("b"))))
    right = own.withColumnRenamed("b", "c").withColumn("b", F.explode(F.filter(each, lambda b: b <= F.col("c"))))

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"u": [], "v": []}
        if a.num_rows and b.num_rows:
            r = _matrix(a.column("x")) @ _matrix(b.column("x")).T
            p, q = a.column("k").to_pylist(), b.column("k").to_pylist()
            same = a.column("b")[0].as_py() == a.column("c")[0].as_py()
            test = _dependence(r, n, alpha)
            for i, j in zip(*np.nonzero(test), strict=True):
                if p[i] < q[j] or (not same and p[i] != q[j]):
                    out["u"].append(min(p[i], q[j]))
                    out["v"].append(max(p[i], q[j]))
        return pa.table({k: pa.array(v, pa.string()) for k, v in out.items()})

    return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(pairs, "u string, v string")


def _dependence(r: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Fisher's z test of each correlation, as in independence()."""
    import math

    if n - 3 <= 0:
        return np.zeros(r.shape, bool)
    z = math.sqrt(n - 3) * np.abs(np.arctanh(np.clip(r, -0.999999, 0.999999)))
    low, high = 0.0, 40.0  # the z at which the test's p is alpha
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) > alpha else (low, mid)
    return z >= high


def separated(edges: DataFrame, x: DataFrame, n: int, size: int, alpha: float) -> DataFrame:
    """Edges that some set of ``size`` neighbours of one end separates, with the first such set."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("near"))
    wide = near.filter(F.size("near") > size)
    work = lambda d: max(1, -(-d * comb(d - 1, size) // TESTS))
    degrees = [r[0] for r in wide.select(F.size("near")).distinct().collect()]  # one for each degree
    parts = F.element_at(F.create_map(*[F.lit(v) for d in degrees or [1] for v in (d, work(d))]), F.size("near"))
    tasks = wide.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # the node's own series and its neighbours', each with its own neighbours
    member = tasks.select(F.col("u").alias("node"), "part", "parts", F.explode(F.concat(F.array("u"), "near")).alias("k"))
    rows = member.join(x, "k").join(near.withColumnRenamed("u", "k"), "k")

    def run(t: pa.Table) -> pa.Table:
        names, node = t.column("k").to_pylist(), t.column("node")[0].as_py()
        part, parts = t.column("part")[0].as_py(), t.column("parts")[0].as_py()
        order = sorted(range(len(names)), key=names.__getitem__)
        names = [names[i] for i in order]
        at = {k: i for i, k in enumerate(names)}
        m = _matrix(t.column("x"))[order]
        around = [set(s) for s in (t.column("near")[i].as_py() for i in order)]
        r = m @ m.T
        np.fill_diagonal(r, 1.0)
        test, mine = independence(r, n, alpha), sorted(set(names) - {node})
        out: dict[str, list] = {"u": [], "v": [], "given": [], "rank": []}
        for k, other in enumerate(mine):
            if k % parts != part:
                continue
            theirs = around[at[other]]
            pool = sorted(set(mine) - {other}, key=lambda c: (-(c in theirs), c))
            for given in combinations(pool, size):
                i, j = sorted((at[node], at[other]))
                if test(i, j, tuple(sorted(at[c] for c in given))):
                    out["u"].append(min(node, other))
                    out["v"].append(max(node, other))
                    out["given"].append(list(given))
                    # of two sets, one from each end, the one that more of both neighbourhoods hold comes first, then by name
                    out["rank"].append([f"{int(c not in theirs)}{c}" for c in given])
                    break
        kinds = {"u": pa.string(), "v": pa.string(), "given": pa.list_(pa.string()), "rank": pa.list_(pa.string())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    found = rows.groupBy("node", "part").applyInArrow(run, f"{APART}, rank array<string>")
    return found.groupBy("u", "v").agg(F.min_by("given", F.struct("rank")).alias("given"))


def skeleton(series: DataFrame, key: str, alpha: float = 0.01, most: int = 3, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that no set of up to ``most`` neighbours separates, and the sets (not empty) of those that one does."""
    spark = series.sparkSession
    x = cut(vectors(series, key))
    n = x.agg(F.max(F.size("x"))).first()[0] or 0
    apart = spark.createDataFrame([], APART)
    if n < least:
        return spark.createDataFrame([], "u string, v string"), apart
    edges = cut(dependent(x, n, alpha))
    for size in range(1, most + 1):
        gone = cut(separated(edges, x, n, size, alpha))
        apart = apart.unionByName(gone)
        left = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count("*").alias("n"))
        edges = cut(edges.join(gone.select("u", "v"), ["u", "v"], "left_anti"))
        if left.filter(F.col("n") > size + 1).isEmpty():
            break
    return edges, apart


def oriented(edges: DataFrame, apart: DataFrame) -> DataFrame:
    """(u, v, directed): edges with colliders and what follows from them by Meek's four rules."""
    ends = lambda df, a, b: df.select(F.col("u").alias(a), F.col("v").alias(b))
    linked = cut(edges.select("u", "v").unionByName(ends(edges, "v", "u").select("u", "v")))
    # collider c between a < b that aren't linked, unless c separates them
    two = ends(linked, "c", "a").join(ends(linked, "c", "b"), "c").filter("a < b").join(ends(linked, "a", "b"), ["a", "b"], "left_anti")
    two = two.join(apart.select(F.col("u").alias("a"), F.col("v").alias("b"), "given"), ["a", "b"], "left")
    tips = two.filter(F.col("given").isNull() | ~F.array_contains("given", F.col("c"))).select(F.explode(F.array("a", "b")).alias("u"), F.col("c").alias("v"))
    arrows = cut(_first(tips.distinct()))
    while True:
        loose = linked.join(arrows, ["u", "v"], "left_anti").join(ends(arrows, "v", "u").select("u", "v"), ["u", "v"], "left_anti")
        new = cut(_first(_follow(linked, arrows, cut(loose)).distinct()))
        if new.isEmpty():
            break
        arrows = cut(arrows.unionByName(new))
    plain = edges.join(arrows, ["u", "v"], "left_anti").join(ends(arrows, "v", "u").select("u", "v"), ["u", "v"], "left_anti")
    return arrows.withColumn("directed", F.lit(True)).unionByName(plain.select("u", "v").withColumn("directed", F.lit(False)))


def _first(arrows: DataFrame) -> DataFrame:
    """Of two arrows that contradict each other the one to the smaller node."""
    back = arrows.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("back"))
    return arrows.join(back, ["u", "v"], "left").filter(F.col("back").isNull() | (F.col("v") < F.col("u"))).select("u", "v")


def _follow(linked: DataFrame, arrows: DataFrame, loose: DataFrame) -> DataFrame:
    """Arrows u -> v for loose edges u - v, by each rule."""
    e = lambda df, a, b: df.select(F.col("u").alias(a), F.col("v").alias(b))
    goal = e(loose, "u", "v")
    one = e(arrows, "w", "u").join(goal, "u").filter("w <> v").join(e(linked, "w", "v"), ["w", "v"], "left_anti").select("u", "v")
    two = e(arrows, "u", "w").join(e(arrows, "w", "v"), "w").join(goal, ["u", "v"]).select("u", "v")
    side = e(loose, "u", "c").join(e(arrows, "c", "v"), "c").join(goal, ["u", "v"])
    three = side.join(side.select("u", "v", F.col("c").alias("d")), ["u", "v"]).filter("c < d").join(e(linked, "c", "d"), ["c", "d"], "left_anti").select("u", "v")
    far = e(loose, "u", "c").join(e(arrows, "c", "d"), "c").join(e(arrows, "d", "v"), "d").join(goal, ["u", "v"]).filter("c <> v")
    four = far.join(e(linked, "u", "d"), ["u", "d"]).join(e(linked, "c", "v"), ["c", "v"], "left_anti").select("u", "v")
    return one.unionByName(two).unionByName(three).unionByName(four)


def causal_graph(series: DataFrame, key: str, **settings) -> DataFrame:
    """series(key, bin, n), dense -> (u, v, directed); no edge with fewer than ``least`` bins."""
    return oriented(*skeleton(series, key, **settings))


def intervened(graph: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graph(u, v, directed) with edges at intervened nodes (first column of sources) pointing away from them, followed by
    Meek's rules; and the conflicts (source, parent): arrows into such a node, which stay."""
    s = sources.select(F.col(sources.columns[0]).cast("string").alias("u")).distinct()
    arrows, loose = graph.filter("directed").select("u", "v"), graph.filter("not directed").select("u", "v")
    conflicts = arrows.join(s.withColumnRenamed("u", "v"), "v").select(F.col("v").alias("source"), F.col("u").alias("parent"))
    both = loose.unionByName(loose.select(F.col("v").alias("u"), F.col("u").alias("v")))
    arrows = cut(arrows.unionByName(_first(both.join(s, "u").select("u", "v"))))
    linked = graph.select("u", "v")
    linked = cut(linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    back = lambda a: a.select(F.col("v").alias("u"), F.col("u").alias("v"))
    while True:
        left = linked.join(arrows, ["u", "v"], "left_anti").join(back(arrows), ["u", "v"], "left_anti")
        new = cut(_first(_follow(linked, arrows, cut(left)).distinct()))
        if new.isEmpty():
            break
        arrows = cut(arrows.unionByName(new))
    plain = loose.join(arrows, ["u", "v"], "left_anti").join(back(arrows), ["u", "v"], "left_anti")
    out = arrows.withColumn("directed", F.lit(True)).unionByName(plain.withColumn("directed", F.lit(False)))
    return out, conflicts
