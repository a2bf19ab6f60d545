"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has 2**16 positions. Each shard owns ``virtual`` points on it; a row's
position is a hash of its key, its home the next point clockwise. Every shard
has a capacity and capacities sum to the number of rows, so that counts differ
by one at most: rows beyond a full shard's capacity go on clockwise to the
next shard with room. Homes are served before overflow: round j offers each
arc's remaining rows to the j-th distinct shard clockwise from it, arcs in
ring order, so rows move only where a shard is full.

What is planned centrally is bounded by the ring: a count for each of 65,536
positions, folded by array functions into (arc, rank range, shard) segments.
A row needs its rank within its position only; positions spread by hash, so no
key is hot. Edge cases: a null text has size 16 and crc 0; a null id hashes as
the empty text; rows that repeat id and text tie and take consecutive slots;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RING_BITS = 16
VIRTUAL = 24


def ring_points(shards: int, virtual: int = VIRTUAL, seed: str = "ring") -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes, sorted by position; parameters alone decide."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual):
            p = zlib.crc32(f"{seed}:{s}:{v}".encode()) >> (32 - RING_BITS)
            while p in taken:
                p = (p + 1) % (1 << RING_BITS)
            taken[p] = s
    return sorted(taken.items())


def _clockwise(points: list[tuple[int, int]]) -> list[list[int]]:
    """For each arc the distinct shards in clockwise order from its end."""
    out = []
    for i in range(len(points)):
        order = dict.fromkeys(points[(i + j) % len(points)][1] for j in range(len(points)))
        out.append(list(order))
    return out


def ring_position(*keys: Column) -> Column:
    """Position on the ring, from the top bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - RING_BITS).cast("int")


def plan_segments(counts: DataFrame, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """counts: (pos, n) of at most 2**16 rows. Gives (pos, first, last, shard, slot0).

    A row of position pos and rank r (from 0) in [first, last) goes to shard,
    slot slot0 + r - first.
    """
    points = ring_points(shards, virtual)
    ends = [p for p, _ in points]
    arcs = len(points)
    # a position's arc ends at the first point at or after it; beyond the last point the ring closes
    spans = [[lo, hi, a] for a, (lo, hi) in enumerate(zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True))]
    spans.append([ends[-1] + 1, (1 << RING_BITS) - 1, 0])
    ring = counts.sparkSession.range(1).select(
        F.explode(F.from_json(F.lit(str([x for x in spans if x[0] <= x[1]])), "array<array<int>>")).alias("s")
    ).select(F.explode(F.sequence(F.col("s")[0], F.col("s")[1])).alias("pos"), F.col("s")[2].alias("arc"))
    at = counts.join(ring, "pos").select("pos", "n", "arc")
    at = at.withColumn("before", F.sum("n").over(W.partitionBy("arc").orderBy("pos")) - F.col("n"))
    per_arc = at.groupBy("arc").agg(F.sum("n").alias("n"))
    # one row: arcs' counts in ring order
    folded = per_arc.agg(
        F.map_from_entries(F.collect_list(F.struct("arc", "n"))).alias("m"), F.sum("n").alias("total")
    ).select(
        F.transform(F.sequence(F.lit(0), F.lit(arcs - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("left"),
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: (F.col("total") - s + shards - 1).cast("long"),
        ).alias("room"),
    )
    order = F.from_json(F.lit(str(_clockwise(points))), "array<array<int>>").alias("order")
    folded = folded.select(
        "left", F.transform("room", lambda r: F.floor(r / shards).cast("long")).alias("room"), order
    )
    # state: rows still to place by arc, room by shard, segments so far as (arc, shard, rows)
    folded = folded.selectExpr(
        f"""aggregate(sequence(0, {shards - 1}),
             named_struct('left', left, 'room', room,
                          'seg', cast(array() as array<struct<round:int,arc:int,shard:int,n:bigint>>)),
             (st, j) -> if(aggregate(st.left, 0L, (x, y) -> x + y) = 0, st,
               aggregate(sequence(0, {arcs - 1}),
                 named_struct('left', cast(array() as array<bigint>), 'room', st.room, 'seg', st.seg),
                 (s2, a) -> if(st.left[a] = 0 or s2.room[order[a][j]] = 0,
                   named_struct('left', concat(s2.left, array(st.left[a])), 'room', s2.room, 'seg', s2.seg),
                   named_struct(
                     'left', concat(s2.left, array(st.left[a] - least(st.left[a], s2.room[order[a][j]]))),
                     'room', transform(s2.room, (r, s) ->
                        if(s = order[a][j], r - least(st.left[a], r), r)),
                     'seg', concat(s2.seg, array(named_struct('round', j, 'arc', a, 'shard', order[a][j],
                        'n', least(st.left[a], s2.room[order[a][j]]))))))))).seg as seg"""
    )
    seg = folded.select(F.explode("seg").alias("s")).select("s.*")
    by_arc, by_shard = W.partitionBy("arc").orderBy("round"), W.partitionBy("shard").orderBy("round", "arc")
    seg = seg.select(
        "arc", "shard",
        (F.sum("n").over(by_arc) - F.col("n")).alias("lo"), F.sum("n").over(by_arc).alias("hi"),
        (F.sum("n").over(by_shard) - F.col("n")).alias("slot0"),
    )
    # cut the segments at positions, so that rows join by position alone
    return (
        at.filter("n > 0").join(seg, "arc")
        .filter((F.col("hi") > F.col("before")) & (F.col("lo") < F.col("before") + F.col("n")))
        .select(
            "pos", "shard",
            F.greatest(F.col("lo") - F.col("before"), F.lit(0)).alias("first"),
            F.least(F.col("hi") - F.col("before"), F.col("n")).alias("last"),
            (F.col("slot0") + F.greatest(F.col("before") - F.col("lo"), F.lit(0))).alias("slot0"),
        )
    )


def shard_rows(docs: DataFrame, shards: int = 40, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("pos", ring_position(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32")))
    within = W.partitionBy("pos").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1)
    counts = rows.groupBy("pos").agg(F.count("*").alias("n"))
    plan = plan_segments(counts, shards, virtual)
    # one segment a position nearly always; the join splits the few that a capacity cuts
    plan = plan.groupBy("pos").agg(F.collect_list(F.struct("first", "last", "shard", "slot0")).alias("segs"))
    mine = F.filter("segs", lambda s: (s["first"] <= F.col("r")) & (s["last"] > F.col("r")))[0]
    return ranked.join(plan, "pos").withColumn("g", mine).select(
        "doc_id", "size", "text_crc32", F.col("g.shard").alias("shard"),
        (F.col("g.slot0") + F.col("r") - F.col("g.first")).cast("long").alias("slot"),
    )
