"""Review queues: proposals with deterministic ids, decisions, merges, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import uuid5

#: Fixed value: the namespace of proposal ids (the URL namespace of RFC 4122).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def propose(found: DataFrame, kind: str, name: Column) -> DataFrame:
    """Adds proposal_id, from what is proposed, so a second run updates instead of adding."""
    return found.withColumn("proposal_id", uuid5(NAMESPACE, F.concat_ws("|", F.lit(kind), name)))


def upsert(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """Open proposals take the fresh evidence, decided ones keep theirs, new ones are open."""
    q = queue.select("proposal_id", F.col("status").alias("s"), F.col("evidence").alias("e"))
    x = q.join(fresh.select("proposal_id", F.col("evidence").alias("f")), "proposal_id", "full")
    open_ = F.coalesce("s", F.lit("open")) == "open"
    return x.select(
        "proposal_id", F.coalesce("s", F.lit("open")).alias("status"),
        F.when(open_, F.coalesce("f", "e")).otherwise(F.col("e")).alias("evidence"))


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision (proposal_id, status, at) of each proposal takes effect."""
    last = decisions.groupBy("proposal_id").agg(F.max_by("status", "at").alias("d"))
    return queue.join(last, "proposal_id", "left").withColumn("status", F.coalesce("d", "status")).drop("d")


#: Consequence of a severity.
CONSEQUENCE, UNKNOWN_CONSEQUENCE = {"CRITICAL": 1.0, "ERROR": 0.8, "WARN": 0.5, "WARNING": 0.5, "INFO": 0.2, "DEBUG": 0.05}, 0.3
LEAST_HITS, LEAST_PMI, ENTITY_SLOTS = 3, 3.0, ("IRI", "UUID", "ENUM")
SEED = ("proposal_type", "name", "strategy", "confidence", "evidence_volume", "evidence_recency", "cross_domain", "consistency_risk")


def seed(templates: DataFrame, slots: DataFrame, edges: DataFrame, causal: DataFrame | None = None) -> DataFrame:
    """Proposals from mined results: the columns of SEED, and proposal_id, the same for the same find.

    templates(cluster_id, hits, severity) with enough hits are events,
    slots(cluster_id, slot, slot_type, n, pii_risk) of entity types are entities,
    edges(src, dst, pmi, cooc, directed) are relationships, or causal edges where
    they are directed and in causal(src, dst, confidence, granger_p), the gate's result.
    """
    one = lambda c: F.least(c.cast("double"), F.lit(1.0))
    none = F.lit(0.0)
    weight = F.lit(UNKNOWN_CONSEQUENCE)
    for k, w in CONSEQUENCE.items():
        weight = F.when(F.upper("severity") == k, w).otherwise(weight)
    put = lambda df, *cols: df.select(*[c.alias(n) for c, n in zip(cols, SEED, strict=True)])
    events = put(
        templates.filter(F.col("hits") >= LEAST_HITS), F.lit("LOG_EVENT"), F.concat(F.lit("cluster:"), "cluster_id"),
        F.lit("LOG_TEMPLATE_CLUSTERING"), one(0.4 + 0.05 * F.col("hits")), one(F.col("hits") / 50), weight, none, none)
    entities = put(
        slots.filter(F.col("slot_type").isin(*ENTITY_SLOTS)), F.lit("LOG_ENTITY"), F.concat_ws(":", "cluster_id", "slot", "slot_type"),
        F.lit("LOG_TEMPLATE_CLUSTERING"), one(0.5 + 0.05 * (F.col("n") / 10)), one(F.col("n") / 20), none, none,
        F.when(F.col("pii_risk"), 0.8).otherwise(0.0))
    x = edges.filter(F.col("pmi") >= LEAST_PMI)
    if causal is None:
        x = x.withColumns({"sure": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    else:
        x = x.join(causal.select("src", "dst", F.col("confidence").alias("sure"), F.col("granger_p").alias("p")), ["src", "dst"], "left")
    gated = F.col("directed") & F.col("sure").isNotNull()
    links = put(
        x, F.when(gated, "LOG_CAUSAL_EDGE").otherwise("LOG_RELATIONSHIP"), F.concat_ws("::", "src", "dst"),
        F.when(gated, "GRANGER_CAUSALITY").otherwise("PMI_TEMPORAL_ORDERING"),
        F.when(gated, F.col("sure")).otherwise(one(0.4 + (F.col("pmi") - 3.0) / 10)), one(F.col("cooc") / 30), none,
        one(F.col("pmi") / 10), F.coalesce(1 - F.col("p"), none))
    every = events.unionByName(entities).unionByName(links)
    return propose(every, "log", F.concat_ws(":", F.lower("proposal_type"), "name"))


def candidates(proposals: DataFrame, most: int = 50) -> DataFrame:
    """The review list: highest confidence weighed by consequence first, ties by name (a top-k report)."""
    rank = F.col("confidence") * (1 + F.col("evidence_recency"))
    return proposals.orderBy(F.desc(F.round(rank, 9)), "proposal_type", "name").limit(most)


def merge(queue: DataFrame, session: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queue(proposal_id, status, evidence, ...), session(name, samples), merges(proposal_id, into): both after the merges.

    A merged proposal is approved with a note, and its evidence is added to the
    entry's samples; where there is no such entry it is approved alone.
    """
    known = session.select(F.col("name").alias("into"))
    to = merges.join(known, "into", "left_semi").withColumn("note", F.concat(F.lit("merged-into:"), "into"))
    decided = merges.select("proposal_id").distinct().withColumn("_decided", F.lit(True))
    notes = to.groupBy("proposal_id").agg(F.min("note").alias("note"))
    after = queue.join(decided, "proposal_id", "left").join(notes, "proposal_id", "left").withColumn(
        "status", F.when(F.col("_decided"), "approved").otherwise(F.col("status"))).drop("_decided")
    more = to.join(queue.select("proposal_id", "evidence"), "proposal_id").groupBy(F.col("into").alias("name")).agg(
        F.array_sort(F.collect_list("evidence")).alias("_more"))
    entries = session.join(more, "name", "left").withColumn(
        "samples", F.concat("samples", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
    return after, entries


def calibration_error(rows: DataFrame, chance: str, outcome: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: bins' gaps between mean chance and share, weighted by rows."""
    b = F.least(F.floor(F.col(chance) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(chance).alias("p"), F.avg(F.col(outcome).cast("double")).alias("y"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def divergence(counts: DataFrame, key: str, a: str, b: str, floor: float = 1e-9) -> DataFrame:
    """Kullback-Leibler and Jensen-Shannon divergence of two count columns by key, in bits."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key)
    p, q = (F.greatest(F.col(c) / F.sum(c).over(w), F.lit(floor)) for c in (a, b))
    x = counts.withColumn("_p", p).withColumn("_q", q).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    part = lambda u, v: F.sum(F.col(u) * F.log2(F.col(u) / F.col(v)))
    return x.groupBy(key).agg(
        F.round(part("_p", "_q"), 6).alias("kl"), F.round((part("_p", "_m") + part("_q", "_m")) / 2, 6).alias("js"))


def slices(rows: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """Ordinal windows: row i of n goes to slice i * parts / n."""
    from .ranks import ranked

    x = ranked(rows, [key], order[0], order[1:])
    return x.withColumn("slice", F.floor(F.col("rank") * parts / F.col("n")).cast("int")).drop("rank", "n")


def output_gate(answers: DataFrame, required: dict[str, int]) -> DataFrame:
    """answers(cls, key): classes with too few rows of a key: (cls, key, n)."""
    need = answers.sparkSession.createDataFrame(list(required.items()), "key string, least int")
    got = answers.groupBy("cls", "key").agg(F.count("*").alias("n"))
    every = answers.select("cls").distinct().crossJoin(F.broadcast(need))
    x = every.join(got, ["cls", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.filter("n < least").select("cls", "key", "n")
