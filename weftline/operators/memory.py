"""Bitemporal observation memory: recall, snapshots, supersession, compression, contradiction.

Records: record, entity, kind, agent, method, confidence, value, generated_at,
valid_from, invalidated_by (record or null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def recall(records: DataFrame, like: str, since, until, kind: str | None = None) -> DataFrame:
    """Records whose entity holds a text, in a time range, newest first."""
    x = records.filter(F.lower("entity").contains(like.lower()) & F.col("generated_at").between(F.lit(since), F.lit(until)))
    return x.filter(F.col("kind") == kind) if kind else x


def active(records: DataFrame) -> DataFrame:
    return records.filter("invalidated_by is null")


def as_of(records: DataFrame, valid, known) -> DataFrame:
    """Valid at one time as known at another: not invalidated by a record generated by then."""
    valid, known = F.lit(valid).cast("timestamp_ntz"), F.lit(known).cast("timestamp_ntz")
    then = records.filter((F.col("valid_from") <= valid) & (F.col("generated_at") <= known))
    killers = records.filter(F.col("generated_at") <= known).select(F.col("record").alias("invalidated_by"))
    return then.join(killers, "invalidated_by", "left_anti")


def latest(records: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("generated_at"), F.desc("record"))
    return records.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def agent_diff(records: DataFrame, a: str, b: str) -> DataFrame:
    """The latest rows of two agents by entity and kind, AGREE or DISAGREE."""
    keys = ["entity", "kind"]
    side = lambda who, name: latest(records.filter(F.col("agent") == who), keys).select(*keys, F.col("value").alias(name))
    x = side(a, "value_a").join(side(b, "value_b"), keys)
    return x.withColumn("verdict", F.when(F.col("value_a").eqNullSafe(F.col("value_b")), "AGREE").otherwise("DISAGREE"))


def supersede(records: DataFrame) -> DataFrame:
    """Inferred records with the newest later measurement of the same entity and kind: (record, superseded_by)."""
    m = records.filter("method = 'MEASURED'").groupBy("entity", "kind").agg(
        F.max(F.struct("generated_at", "record")).alias("m")
    )
    x = active(records).filter("method = 'INFERRED'").join(m, ["entity", "kind"])
    return x.filter(F.col("m.generated_at") > F.col("generated_at")).select("record", F.col("m.record").alias("superseded_by"))


def compress(records: DataFrame) -> DataFrame:
    """One summary for each entity and kind with several active rows."""
    return active(records).groupBy("entity", "kind").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("confidence"), 6).alias("confidence")
    ).filter("n > 1")


def compress_old(records: DataFrame, cutoff: str, now: str) -> DataFrame:
    """records with the old measurements of an entity and kind summed up and invalidated by their summary.

    Active measurements generated before the cutoff, two or more of an entity and kind, are invalidated by a
    SYNTHESIZED record that says how many they are, from when to when, and their mean confidence. Its identifier
    follows from entity, kind and cutoff, so a second run finds nothing left to do. All other records stay as they are.
    Identifiers are text in the result; summaries have a text column ``summary`` and no value.
    """
    t = F.lit(cutoff).cast("timestamp_ntz")
    x = records.withColumn("record", F.col("record").cast("string")).withColumn("invalidated_by", F.col("invalidated_by").cast("string"))
    old = F.col("invalidated_by").isNull() & (F.col("method") == "MEASURED") & (F.col("generated_at") < t)
    iri = F.concat(F.lit("memory/summary/"), F.substring(F.sha2(F.concat_ws("|", "entity", "kind", F.lit(cutoff)), 256), 1, 32))
    groups = x.filter(old).groupBy("entity", "kind").agg(
        F.count("*").alias("_n"), F.min("generated_at").alias("_first"), F.max("generated_at").alias("_last"), F.avg("confidence").alias("_confidence"),
    ).filter("_n > 1").withColumn("_iri", iri)
    marked = x.join(groups.select("entity", "kind", "_iri"), ["entity", "kind"], "left")
    marked = marked.withColumn("invalidated_by", F.when(old & F.col("_iri").isNotNull(), F.col("_iri")).otherwise(F.col("invalidated_by")))
    marked = marked.withColumn("summary", F.lit(None).cast("string")).select(*records.columns, "summary")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    text = F.to_json(F.struct(F.lit("temporal_compression").alias("summary_type"), F.col("_n").alias("point_count"), stamp("_first").alias("earliest"), stamp("_last").alias("latest")))
    known = {"record": F.col("_iri"), "entity": F.col("entity"), "kind": F.col("kind"), "method": F.lit("SYNTHESIZED"), "confidence": F.col("_confidence"),
             "generated_at": F.lit(now).cast("timestamp_ntz"), "valid_from": F.col("_first")}
    fresh = groups.select(*[known.get(c, F.lit(None)).cast(t_).alias(c) for c, t_ in marked.drop("summary").dtypes], text.alias("summary"))
    return marked.unionByName(fresh)


def contradictions(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which active records differ in value, with the spread (one row for each key, not for each pair)."""
    g = active(records).groupBy(*keys).agg(
        F.countDistinct("value").alias("n_values"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return g.filter("n_values > 1")


def escalate(records: DataFrame, now: str) -> DataFrame:
    """A conflict record for each pair of active measurements of an entity with different values.

    The identifier is made from the pair, so a second run gives the same records.
    Measurements that agree meet as one row for each value, so a pair is made
    only where values differ; the pairs themselves are the result.
    """
    x = active(records).filter("method = 'MEASURED' and value is not null").select("record", "entity", "value")
    by_value = x.groupBy("entity", "value").agg(F.count("*").alias("_n"))
    odd = by_value.groupBy("entity").agg(F.count("*").alias("_values")).filter("_values > 1").select("entity")
    a = x.join(odd, "entity")
    b = a.select("entity", F.col("record").alias("record_b"), F.col("value").alias("value_b"))
    pair = a.join(b, "entity").filter("record < record_b and value <> value_b")
    return pair.select(
        F.concat(F.lit("memory/conflict/"), F.substring(F.sha2(F.concat_ws("|", "record", "record_b"), 256), 1, 32)).alias("record"),
        "entity", F.lit("CONFLICT").alias("kind"), F.lit("SYNTHESIZED").alias("method"),
        F.lit("MEASURED_CONTRADICTION").alias("conflict_type"), F.col("record").alias("record_a"), "record_b",
        F.substring(F.col("value").cast("string"), 1, 200).alias("value_a"), F.substring(F.col("value_b").cast("string"), 1, 200).alias("value_b"),
        F.lit(now).cast("timestamp_ntz").alias("generated_at"),
    )


def chain(records: DataFrame, steps: int = 2) -> DataFrame:
    """Invalidation chains of up to steps: (record, step, by)."""
    link = records.filter("invalidated_by is not null").select("record", "invalidated_by")
    out, now = None, link.select("record", F.lit(0).alias("step"), F.col("invalidated_by").alias("by"))
    for i in range(steps + 1):
        out = now if out is None else out.unionByName(now)
        if i < steps:
            nxt = link.select(F.col("record").alias("by"), F.col("invalidated_by").alias("nby"))
            now = now.join(nxt, "by").select("record", F.lit(i + 1).alias("step"), F.col("nby").alias("by"))
    return out


def influence(records: DataFrame) -> DataFrame:
    """Agents whose records invalidate another agent's: (src, dst, n)."""
    a = records.select(F.col("invalidated_by").alias("k"), F.col("agent").alias("dst"))
    b = records.select(F.col("record").alias("k"), F.col("agent").alias("src"))
    return a.join(b, "k").filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
