"""Rules over a catalogue: schema losses, keys, junctions, paths, renames, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def losses(columns: DataFrame) -> DataFrame:
    """columns(table_name, column_name, type): what a schema loses, by seven rules: (rule, table_name, column_name)."""
    c = F.lower("column_name")
    has = lambda pattern: F.max(c.rlike(pattern).cast("int")) == 1
    by = columns.groupBy("table_name").agg(
        has(r"(?:_at|_ts|date|time|^ts)$").alias("timed"), has(r"source|ref").alias("sourced"),
        has(r"unit").alias("unit"), has(r"(?:name|label|title|desc)").alias("described"), has(r"value|amount|balance|price").alias("valued"),
        F.count("*").alias("n"),
    )
    cols = lambda rule, cond: columns.filter(cond).select(F.lit(rule).alias("rule"), "table_name", "column_name")
    tabs = lambda rule, cond: by.filter(cond).select(F.lit(rule).alias("rule"), "table_name", F.lit("*").alias("column_name"))
    return reduce(DataFrame.unionByName, [
        cols("STATUS_AS_EVENT", c.rlike(r"(?:status|state|flag)$")), cols("IMPLICIT_ACTOR", c.rlike(r"(?:_by|user_id|owner|custkey)$")),
        cols("OVERLOADED_TYPE", c.rlike(r"(?:type|kind|category)$")), tabs("MISSING_TIMESTAMP", "not timed"),
        tabs("FLOATING_VALUE", "valued and not unit"), tabs("MISSING_SOURCE_REF", "not sourced"), tabs("MISSING_METADATA", "not described"),
    ])


def junctions(foreign: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that are little more than two or more foreign keys."""
    n = columns.groupBy("table_name").agg(F.count("*").alias("n"))
    k = foreign.groupBy("table_name").agg(F.count("*").alias("keys"), F.countDistinct("target").alias("targets"))
    return k.join(n, "table_name").filter((F.col("targets") >= 2) & (F.col("n") - F.col("keys") <= 3)).select("table_name", "keys", "n")


def key_paths(foreign: DataFrame, most: int = 4) -> DataFrame:
    """Chains of foreign keys of up to most steps: (start, path, stop, steps)."""
    step = foreign.select(F.col("table_name").alias("start"), F.col("target").alias("stop")).distinct()
    now = step.withColumn("path", F.array("start", "stop")).withColumn("steps", F.lit(1))
    out = now
    for i in range(2, most + 1):
        nxt = step.select(F.col("start").alias("stop"), F.col("stop").alias("to"))
        now = now.join(nxt, "stop").filter(~F.expr("array_contains(path, to)")).select(
            "start", F.col("to").alias("stop"), F.concat("path", F.array("to")).alias("path"), F.lit(i).alias("steps"))
        out = out.unionByName(now.select(*out.columns))
    return out


def cardinality(rows: DataFrame, key: str) -> DataFrame:
    """How many rows share a key value: 1:1 or 1:n with the mean and the most."""
    n = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    g = n.agg(F.count("*").alias("keys"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    return g.withColumn("cardinality", F.when(F.col("most") == 1, "1:1").otherwise("1:n"))


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """removed and added (name, signature): pairs with equal non-empty signatures, first to first."""
    side = lambda df, n: df.filter("signature <> ''").withColumn(
        "k", F.row_number().over(W.partitionBy("signature").orderBy("name"))).withColumnRenamed("name", n)
    return side(removed, "old").join(side(added, "new"), ["signature", "k"]).select("old", "new", "signature")


def coverage(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Required elements that are missing, and the share that is there: (key, missing, share)."""
    have = available.select(key).distinct().withColumn("have", F.lit(1))
    x = required.select(key).distinct().join(have, key, "left")
    share = x.agg(F.round(F.avg(F.coalesce("have", F.lit(0))), 6).alias("share"))
    return x.filter("have is null").select(key).crossJoin(F.broadcast(share))


def rule_mentions(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Which rules name which classes as whole tokens, joined on the tokens."""
    t = rules.select("rule", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\w+"), 0))).alias("cls"))
    return t.join(classes.select("cls").distinct(), "cls").select("rule", "cls")


def provenance(records: DataFrame, hops: int = 4) -> DataFrame:
    """records(iri, source_ref): the chain of sources of each record, a fixed number of joins."""
    link = records.select(F.col("iri").alias("k"), F.col("source_ref").alias("up"))
    x = records.select("iri", F.array("iri").alias("chain"), F.col("source_ref").alias("k"))
    for _ in range(hops):
        x = x.join(link, "k", "left").select(
            "iri", F.when(F.col("k").isNotNull() & ~F.expr("array_contains(chain, k)"), F.concat("chain", F.array("k"))).otherwise(
                F.col("chain")).alias("chain"), F.col("up").alias("k"))
    return x.select("iri", "chain", F.size("chain").alias("depth"))


def banded(score, bands: tuple[tuple[float, int], ...] = ((0.9, 5), (0.75, 4), (0.5, 3), (0.25, 2), (1e-9, 1))):
    """A ratio as a score from 0 to 5."""
    out = F.lit(0)
    for least, s in reversed(bands):
        out = F.when(score >= least, s).otherwise(out)
    return out
