"""Approximate nearest neighbours: a forest of random-projection trees.

Inner products become angles by one more coordinate (vectors scaled by the
largest norm, the rest of the length in the new coordinate; queries have 0
there). Each tree halves the space at random projections; thresholds are
medians of a sample of SAMPLE_ROWS rows at most. Every row is indexed: it has a
leaf in each tree. A query searches all trees through one priority queue: the
node whose worst violated margin is smallest comes first, until the leaves
taken hold SHARE of the rows (MIN_CANDIDATES at least). Candidates of the
leaves are ranked exactly, by inner products of the original vectors in double
precision.

Equal vectors are one entry with its TOP + 1 smallest ids, cut before the
shuffle, which is all that can be among the nearest. Leaves and their queries
are cut into blocks of bounded size, so that neither a full leaf nor one that
all queries visit lands in one task. On vectors without any structure (the
test tables are uniform on the sphere) recall of 0.9 needs a constant share of
the rows; with structure, lower ``share``.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as query or candidate; vectors of each length are a
space of their own (between lengths there is no inner product) with a forest of
its own; rows that repeat an id and a vector are one query, an id with several
vectors asks once for each, and rows with the query's id aren't its candidates;
null ids take no part; with fewer than TOP candidates all are returned; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, small_batches

TOP, QUERY_MODULUS = 20, 20
TREES, MAX_DEPTH, LEAF_ROWS = 24, 8, 64
SAMPLE_ROWS, SHARE, MIN_CANDIDATES = 20_000, 0.75, 3_000
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


class Forest:
    """Directions and thresholds of all trees, nodes numbered from the root as in a heap."""

    def __init__(self, sample: np.ndarray, rows: int, norm: float, trees: int = TREES, seed: int = 3):
        self.norm, self.trees, dim = norm, trees, sample.shape[1]
        self.depth = int(np.clip(np.log2(max(rows, 1) / LEAF_ROWS), 0, MAX_DEPTH))
        rng = np.random.default_rng(seed)
        nodes = 1 << self.depth
        self.direction = rng.normal(size=(trees, nodes, dim + 1)).astype(np.float32)
        self.direction /= np.linalg.norm(self.direction, axis=2, keepdims=True)
        self.cut = np.zeros((trees, nodes), np.float32)
        x = self.lift(sample)
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for d in range(self.depth):
                p = np.einsum("nd,nd->n", x, self.direction[t, node])
                for k in range(1 << d, 2 << d):
                    at = node == k
                    if at.any():
                        self.cut[t, k] = np.median(p[at])
                node = 2 * node + (p > self.cut[t, node])

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows to index, on the unit sphere of one more dimension."""
        x = x / self.norm
        rest = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Cell (tree * leaves + leaf) of each row in each tree."""
        x, out = self.lift(x), np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("nd,nd->n", x, self.direction[t, node])
                node = 2 * node + (p > self.cut[t, node])
            out[:, t] = node - (1 << self.depth) + (t << self.depth)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, budget: float) -> list[list[int]]:
        """Cells that each query takes, nearest first, until they hold budget rows."""
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        flat = self.direction[:, :, :-1].reshape(-1, q.shape[1])
        margin = q.astype(np.float32) @ flat.T - self.cut.reshape(-1)
        nodes, out = 1 << self.depth, []
        for row in margin.tolist():
            queue = [(0.0, t, 1) for t in range(self.trees)]
            taken, got = [], 0.0
            while queue and got < budget:
                worst, t, k = heapq.heappop(queue)
                while k < nodes:  # down the near side; the far side waits with its margin
                    m = row[t * nodes + k]
                    near = 2 * k + (m > 0)
                    heapq.heappush(queue, (max(worst, abs(m)), t, near ^ 1))
                    k = near
                cell = (t << self.depth) + k - nodes
                taken.append(cell)
                got += sizes[cell]
            out.append(taken)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _top(scores: np.ndarray, ids: list[np.ndarray], own: int, k: int) -> list[tuple[int, float]]:
    """The k best (id, score) of one query in a block; ids: of each entry, ascending."""
    if len(scores) > k + 1:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
    else:
        some = np.arange(len(scores))
    all_ = [(-float(scores[i]), int(v)) for i in some for v in ids[i] if v != own]
    return [(v, -s) for s, v in heapq.nsmallest(k, all_)]


def nearest(vectors: DataFrame, scratch: Scratch, share: float = SHARE, top: int = TOP, modulus: int = QUERY_MODULUS) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score) for queries with vec_id % modulus = 0."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(v, x -> x <> 0)"
    )
    lengths = [r["n"] for r in usable.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # one row for each length
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        part = _nearest(usable.filter(F.size("v") == n), Scratch(spark, "ann") if len(lengths) > 1 else scratch, share, top, modulus)
        found = part if len(lengths) == 1 else found.unionByName(part)
    return found


def _nearest(usable: DataFrame, scratch: Scratch, share: float, top: int, modulus: int) -> DataFrame:
    """The same for usable(vec_id, v), vectors of one length."""
    spark = usable.sparkSession
    # Spark cuts each group to its first rows before the shuffle
    few = usable.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("k") <= top + 1)
    entries = scratch.save(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    about = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, norm = int(about[0]), float(np.sqrt(about[1]))
    sample = entries.orderBy(F.xxhash64("ids"), F.col("ids")[0]).limit(SAMPLE_ROWS).select("v").toArrow()
    forest = spark.sparkContext.broadcast(Forest(_vectors(sample.column(0)), n, norm))
    cells = TREES << forest.value.depth

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = forest.value.leaves(_vectors(b.column(0)))
                offs = pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.ListArray.from_arrays(offs, pa.array(at.reshape(-1)))],
                    names=["v", "ids", "cells"],
                )

    planted = scratch.save(
        entries.select("v", "ids").mapInArrow(plant, "v array<double>, ids array<long>, cells array<int>"), "planted"
    )
    sized = planted.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    sizes = np.zeros(cells, np.int64)
    sizes[sized["cell"]] = sized["n"]
    known = spark.sparkContext.broadcast(sizes)
    budget = max(share * n, MIN_CANDIDATES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = forest.value.search(_vectors(b.column(1)), known.value, budget)
                offs = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32))
                flat = pa.array(np.concatenate(got).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.ListArray.from_arrays(offs, flat)], names=["query_id", "q", "cells"]
                )

    queries = usable.filter(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    asked = queries.mapInArrow(ask, "query_id long, q array<double>, cells array<int>")
    asked = scratch.save(asked.withColumn("ask", F.monotonically_increasing_id()), "asked")  # numbers are fixed where they are written
    visits = asked.select("ask", "query_id", "q", F.explode("cells").alias("cell"))
    asked_n = visits.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    by_cell = np.zeros(cells, np.int64)
    by_cell[asked_n["cell"]] = asked_n["n"]
    parts = np.maximum(1, -(-sizes // BLOCK_ROWS))
    q_parts = np.maximum(1, -(-by_cell // BLOCK_QUERIES))
    # one row for each cell, a number that parameters fix
    cuts = F.broadcast(
        spark.range(1).select(
            F.explode(F.from_json(F.lit(str([[int(c), int(p), int(q)] for c, (p, q) in enumerate(zip(parts, q_parts, strict=True))
                                             if by_cell[c]])), "array<array<int>>")).alias("c")
        ).select(F.col("c")[0].alias("cell"), F.col("c")[1].alias("parts"), F.col("c")[2].alias("q_parts"))
    )
    key = lambda part, q_part: (F.col("cell").cast("long") * 1_000_000 + part) * 1_000_000 + q_part
    rows = planted.select("v", "ids", F.explode("cells").alias("cell")).join(cuts, "cell")
    rows = rows.withColumn("p", F.pmod(F.xxhash64("ids"), F.col("parts"))).select(
        "v", "ids", F.explode(F.transform(F.sequence(F.lit(0), F.col("q_parts") - 1), lambda j: key(F.col("p"), j))).alias("block")
    )
    visits = visits.join(cuts, "cell").withColumn("p", F.pmod(F.xxhash64("ask"), F.col("q_parts"))).select(
        "ask", "query_id", "q",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: key(j, F.col("p")))).alias("block"),
    )

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, float]] = []
        if left.num_rows and right.num_rows:
            x, q = _vectors(left.column("v")), _vectors(right.column("q"))
            ids = [np.array(i) for i in left.column("ids").to_pylist()]
            scores = q @ x.T
            for ask, own, s in zip(right.column("ask").to_pylist(), right.column("query_id").to_pylist(), scores, strict=True):
                found += [(ask, own, v, z) for v, z in _top(s, ids, own, top)]
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        names = ("ask", "query_id", "vec_id")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols[:3], strict=True)} | {"score": pa.array(cols[3], pa.float64())})

    ranked = rows.groupBy("block").cogroup(visits.groupBy("block")).applyInArrow(rank, "ask long, query_id long, vec_id long, score double")
    best = ranked.groupBy("ask", "query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("query_id", "rank", "vec_id", "score")
