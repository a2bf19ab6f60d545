"""Ontology-bounded retrieval over embedding records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.vector import cosine

#: Sensitivity tiers in rising order.
TIERS = ("Public", "Internal", "Confidential", "Restricted")


def tier_rank(tier: Column) -> Column:
    """Rank from 0; what isn't a known tier ranks above all, so it is refused."""
    out = F.lit(len(TIERS))
    for i, t in enumerate(TIERS):
        out = F.when(tier == t, i).otherwise(out)
    return out


def allowed(records: DataFrame, ceiling: str, classes: list[str] | None = None, column: str = "tier") -> DataFrame:
    """Records within a ceiling and in the classes; an unknown ceiling is an error, an empty class list admits nothing."""
    if ceiling not in TIERS:
        raise ValueError(f"unknown tier {ceiling!r}")
    x = records.filter(tier_rank(F.col(column)) <= TIERS.index(ceiling))
    return x if classes is None else x.filter(F.col("cls").isin(*classes)) if classes else x.filter(F.lit(False))


def search(records: DataFrame, vector: list[float], k: int, factor: int = 1) -> DataFrame:
    """The k * factor nearest by cosine, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return records.withColumn("sim", F.round(cosine(F.col("embedding"), q), 6)).orderBy(F.desc("sim"), "vec_id").limit(k * factor)


def composite(hits: DataFrame, k: int) -> DataFrame:
    """sim * clamp(confidence, .1, 1) * 0.5 ** (age / 30); missing parts count as 1."""
    conf = F.coalesce(F.least(F.greatest("confidence", F.lit(0.1)), F.lit(1.0)), F.lit(1.0))
    age = F.coalesce(F.pow(F.lit(0.5), F.col("age_days") / 30.0), F.lit(1.0))
    return hits.withColumn("score", F.round(F.col("sim") * conf * age, 6)).orderBy(F.desc("score"), "vec_id").limit(k)


#: Queries that one broadcast holds.
QUERY_BLOCK = 10_000


def search_many(records: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """k nearest of each query: (qid, vec_id, sim, rank). The queries meet all records in blocks of bounded size."""
    blocks = queries.count() // block + 1
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    found, w = None, W.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")
    for i in range(blocks):
        some = numbered.filter(F.col("_block") == i).drop("_block")  # about block rows, whatever the number of queries
        x = records.crossJoin(F.broadcast(some)).select(
            "qid", "vec_id", "label", "qlabel", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))
        x = x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found = x if found is None else found.unionByName(x)
    return found


def unchanged_removed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that the index doesn't hold under the same hash."""
    return rows.join(index, ["iri", "content_hash"], "left_anti")


def retrieval_metrics(plain: DataFrame, bounded: DataFrame, queries: DataFrame, times: DataFrame) -> DataFrame:
    """(strategy, queries, precision, mrr, wrong_class_blocked, p50_ms, p95_ms) of two rankings of the same queries.

    plain and bounded(qid, vec_id, cls, rank) are hits without and within the expected class, queries(qid, expected), times(strategy,
    qid, ms). wrong_class_blocked is, for the bounded ranking, the share of the plain hits of another class that it doesn't hold:
    1 where there are none, 0 without plain hits. Latencies are those at index n / 2 and round(0.95 n) - 1 of the sorted times.
    """
    good = F.col("cls").eqNullSafe(F.col("expected"))
    held = bounded.select("qid", "vec_id", F.lit(True).alias("held")).distinct()
    wrong = plain.join(queries, "qid").filter(~good).join(held, ["qid", "vec_id"], "left").groupBy("qid").agg(
        (F.count_if(F.col("held").isNull()) / F.count("*")).alias("blocked"))
    some = plain.groupBy("qid").agg(F.count("*").alias("n"))
    blocked = queries.join(wrong, "qid", "left").join(some, "qid", "left").agg(
        F.avg(F.coalesce("blocked", F.when(F.col("n") > 0, 1.0).otherwise(0.0))).alias("wrong_class_blocked"))
    out = None
    for name, hits in (("plain", plain), ("bounded", bounded)):
        by = queries.join(hits, "qid", "left").groupBy("qid").agg(
            F.coalesce(F.count_if(good & F.col("rank").isNotNull()) / F.nullif(F.count("rank"), F.lit(0)), F.lit(0.0)).alias("p"),
            F.coalesce(1 / F.min(F.when(good & F.col("rank").isNotNull(), F.col("rank"))), F.lit(0.0)).alias("rr"))
        one = by.agg(F.count("*").alias("queries"), F.round(F.avg("p"), 4).alias("precision"), F.round(F.avg("rr"), 4).alias("mrr"))
        one = one.crossJoin(F.broadcast(blocked)) if name == "bounded" else one.withColumn("wrong_class_blocked", F.lit(0.0))
        one = one.withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    from .ranks import ranked

    r = ranked(times, ["strategy"], "ms", ["qid"])
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("ms")))
    last = F.greatest(F.lit(0), F.floor(0.95 * F.col("n") + 0.5) - 1)
    late = r.groupBy("strategy").agg(at(F.floor(F.col("n") / 2)).alias("p50_ms"), at(last).alias("p95_ms"))
    return out.withColumn("wrong_class_blocked", F.round("wrong_class_blocked", 4)).join(late, "strategy", "left")


def federated(records: DataFrame, ceiling: str, column: str = "tier") -> DataFrame:
    """What a partner with a ceiling may see: tiers up to it, never the highest, whatever the ceiling; unknown tiers are refused."""
    if ceiling not in TIERS:
        raise ValueError(f"unknown tier {ceiling!r}")
    return records.filter(F.col(column).isin(*TIERS[: min(TIERS.index(ceiling) + 1, len(TIERS) - 1)]))
