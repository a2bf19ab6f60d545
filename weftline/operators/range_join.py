"""Band joins: rows of two sides whose values differ by less than a width.

Values are cut into buckets of the width; one side goes to its own bucket and
both neighbours, so the join is an equality on (keys, bucket) with a residual
filter, which Spark can shuffle, sort and split where keys are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: float, strict: bool = True) -> DataFrame:
    """left columns and right columns prefixed r_, where keys are equal and |left.at - right.at| < width (<= if not strict)."""
    b = F.floor(F.col(at) / width).cast("long")
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn(
        "_b", F.explode(F.array(*[F.floor(F.col(f"r_{at}") / width).cast("long") + i for i in (-1, 0, 1)]))
    )
    l = left.withColumn("_b", b)
    on = (l["_b"] == r["_b"])
    for k in keys:
        on = on & (l[k] == r[f"r_{k}"])
    gap = F.abs(F.col(at) - F.col(f"r_{at}"))
    return l.join(r, on).drop("_b").filter(gap < width if strict else gap <= width)


def seconds(ts) -> object:
    """A timestamp without zone as seconds."""
    return F.unix_micros(F.to_timestamp(ts)) / F.lit(1e6)


#: A bucket of time in which a kind comes more often than this, on average, is counted by running sums.
REPEATS = 8
#: Rows of one side of a bucket that one task pairs.
SLICE = 2_000


def ordered_pair_counts(rows: DataFrame, kind: str, micros: str, width: int) -> DataFrame:
    """How many pairs of rows lie within width of each other, by kind: (x, y, later, same), as pair_rows() counts them."""
    return pair_rows(rows, kind, micros, width).groupBy("x", "y").agg(F.sum("later").alias("later"), F.sum("same").alias("same"))


def pair_rows(rows: DataFrame, kind: str, micros: str, width: int) -> DataFrame:
    """Parts of the counts of pairs within width, to be summed by kinds: (x, y, later, same).

    later counts pairs with 0 < y's time - x's time <= width, same those with
    equal times. Rows are counted by (kind, time) first, and times cut into
    buckets of the width; a row of x meets its own bucket and the next one,
    moved back by the width. Where kinds repeat little, these rows meet in a
    join, sliced where a bucket is large: what comes out of it is about the
    result. Where kinds repeat (REPEATS), no pair is made: each time of x reads
    two running counts of y, and the work is rows times the kinds of the bucket.
    """
    n = rows.groupBy(F.col(kind).alias("k"), F.col(micros).alias("t")).agg(F.count("*").alias("n"))
    n = cut(n.withColumn("b", F.floor(F.col("t") / width).cast("long")))  # read four times
    ahead = n.select("b", "k", "t", "n", F.lit(0).alias("step"))
    reach = ahead.unionByName(n.select((F.col("b") - 1).alias("b"), "k", (F.col("t") - width).alias("t"), "n", F.lit(1).alias("step")))
    kinds = reach.groupBy("b", "k").agg(F.count("*").alias("m")).groupBy("b").agg(F.sum("m").alias("m"), F.count("*").alias("kinds"))
    size = kinds.select("b", (F.col("m") > REPEATS * F.col("kinds")).alias("often"), F.ceil(F.col("m") / SLICE).cast("int").alias("slices"))
    own, reach = n.join(size, "b"), reach.join(size, "b")
    often, seldom = F.col("often"), ~F.col("often")
    return _paired(own.filter(seldom), reach.filter(seldom)).unionByName(_counted(own.filter(often), reach.filter(often)))


def _paired(own: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs by a join on buckets: x's rows are dealt into slices, y's go to each."""
    x = own.select("b", F.col("k").alias("x"), "t", F.col("n").alias("weight"), F.pmod(F.xxhash64("k", "t"), F.col("slices")).cast("int").alias("slice"))
    y = reach.select("b", F.col("k").alias("y"), F.col("t").alias("at"), F.col("n").alias("other"), "step",
                     F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    # moved rows of the next bucket are within the width up to x's own time
    pair = x.join(y, ["b", "slice"]).filter(F.when(F.col("step") == 0, F.col("at") >= F.col("t")).otherwise(F.col("at") <= F.col("t")))
    product, zero = F.col("weight") * F.col("other"), F.lit(0).cast("long")
    same = (F.col("step") == 0) & (F.col("at") == F.col("t"))
    return pair.select("x", "y", F.when(same, zero).otherwise(product).alias("later"), F.when(same, product).otherwise(zero).alias("same"))


def _counted(own: DataFrame, reach: DataFrame) -> DataFrame:
    """The same counts by running sums of y at the times of x."""
    present = reach.select("b", F.col("k").alias("y")).distinct()
    zero = F.lit(0).cast("long")
    at = lambda step: F.when(F.col("step") == step, F.col("n")).otherwise(zero)
    asked = own.select("b", "t", F.col("k").alias("x"), F.col("n").alias("weight")).join(present, "b").select(
        "b", "y", "t", zero.alias("own"), zero.alias("next"), "x", "weight")
    none = [F.lit(None).cast(dict(asked.dtypes)["x"]).alias("x"), F.lit(None).cast("long").alias("weight")]
    every = asked.unionByName(reach.select("b", F.col("k").alias("y"), "t", at(0).alias("own"), at(1).alias("next"), *none))
    so_far = W.partitionBy("b", "y").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    now, whole = W.partitionBy("b", "y").orderBy("t").rangeBetween(0, 0), W.partitionBy("b", "y")
    later = F.sum("own").over(whole) - F.sum("own").over(so_far) + F.sum("next").over(so_far)
    each = every.select("x", "y", "weight", later.alias("later"), F.sum("own").over(now).alias("same")).filter("weight is not null")
    return each.select("x", "y", (F.col("weight") * F.col("later")).alias("later"), (F.col("weight") * F.col("same")).alias("same"))
