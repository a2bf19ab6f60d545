"""Observation memory over events: the user is the entity, the type the kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.operators import conflict as C
from weftline.operators import memory as M
from weftline.operators.range_join import seconds
from weftline.session import table


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observation records; every seventh is invalidated by a later one, when that exists."""
    e = table(spark, sf_dir, "events")
    methods = F.array(*[F.lit(x) for x in ("MEASURED", "INFERRED", "IMPORTED", "SYNTHESIZED")])
    x = e.select(
        F.col("event_id").alias("record"), F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("kind"),
        F.concat(F.lit("agent"), F.col("event_id") % 3).alias("agent"),
        F.element_at(methods, (F.col("event_id") % 4 + 1).cast("int")).alias("method"),
        ((F.col("event_id") % 10) / 10 + 0.05).alias("confidence"), F.round("value", 2).alias("value"),
        F.col("ts").alias("generated_at"), F.col("ts").alias("valid_from"),
        F.when(F.col("event_id") % 7 == 0, F.col("event_id") + 5).alias("invalidated_by"),
    )
    return x


OBS = """o AS (SELECT event_id AS record, CAST(user_id AS VARCHAR) AS entity, event_type AS kind, concat('agent', event_id % 3) AS agent,
 (['MEASURED', 'INFERRED', 'IMPORTED', 'SYNTHESIZED'])[event_id % 4 + 1] AS method, (event_id % 10) / 10 + 0.05 AS confidence, round(value, 2) AS value,
 ts AS generated_at, ts AS valid_from, CASE WHEN event_id % 7 = 0 THEN event_id + 5 END AS invalidated_by FROM events)"""
T1, T2 = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@query(f"WITH {OBS} SELECT record, entity, kind, generated_at FROM o WHERE entity LIKE '%1%' AND generated_at BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}' AND kind = 'error'")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an entity pattern in a time range."""
    o = observations(spark, sf_dir)
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return M.recall(o, "1", t(T1), t(T2), "error").select("record", "entity", "kind", "generated_at")


@query(f"""WITH {OBS} SELECT record, entity, kind, value FROM o x WHERE valid_from <= TIMESTAMP '{T1}' AND generated_at <= TIMESTAMP '{T2}'
 AND NOT EXISTS (SELECT 1 FROM o k WHERE k.record = x.invalidated_by AND k.generated_at <= TIMESTAMP '{T2}')""")
def bitemporal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid at one time as known at another."""
    return M.as_of(observations(spark, sf_dir), T1, T2).select("record", "entity", "kind", "value")


@query(f"""WITH {OBS}, l AS (SELECT *, row_number() OVER (PARTITION BY agent, entity, kind ORDER BY generated_at DESC, record DESC) AS k FROM o)
SELECT a.entity AS entity, a.kind AS kind, a.value AS value_a, b.value AS value_b, CASE WHEN a.value IS NOT DISTINCT FROM b.value THEN 'AGREE' ELSE 'DISAGREE' END AS verdict
FROM l a JOIN l b ON a.entity = b.entity AND a.kind = b.kind AND a.k = 1 AND b.k = 1 AND a.agent = 'agent0' AND b.agent = 'agent1'""")
def agent_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest values of two agents compared."""
    return M.agent_diff(observations(spark, sf_dir), "agent0", "agent1")


@query(f"""WITH {OBS}, m AS (SELECT entity, kind, max(generated_at) AS t FROM o WHERE method = 'MEASURED' GROUP BY 1, 2),
mm AS (SELECT m.entity, m.kind, m.t, max(record) AS r FROM m JOIN o ON o.entity = m.entity AND o.kind = m.kind AND method = 'MEASURED' AND generated_at = t GROUP BY 1, 2, 3)
SELECT o.record AS record, mm.r AS superseded_by FROM o JOIN mm USING (entity, kind) WHERE method = 'INFERRED' AND invalidated_by IS NULL AND mm.t > generated_at""")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferences that a newer measurement replaces."""
    return M.supersede(observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT entity, kind, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(confidence), 6) AS confidence FROM o WHERE invalidated_by IS NULL GROUP BY 1, 2 HAVING count(*) > 1")
def memory_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of repeated observations."""
    return M.compress(observations(spark, sf_dir))


@query(f"""WITH {OBS}, g AS (SELECT entity, kind, count(*) AS n, min(generated_at) AS a, max(generated_at) AS z, avg(confidence) AS c, 'memory/summary/' || substr(sha256(entity || '|' || kind || '|' || '{T2}'), 1, 32) AS iri FROM o
 WHERE invalidated_by IS NULL AND method = 'MEASURED' AND generated_at < TIMESTAMP '{T2}' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT CAST(record AS VARCHAR) AS record, o.entity, o.kind, method, round(confidence, 6) AS confidence, CASE WHEN invalidated_by IS NULL AND method = 'MEASURED' AND generated_at < TIMESTAMP '{T2}' AND iri IS NOT NULL THEN iri ELSE CAST(invalidated_by AS VARCHAR) END AS invalidated_by,
 valid_from, NULL AS summary FROM o LEFT JOIN g ON o.entity = g.entity AND o.kind = g.kind
UNION ALL SELECT iri, entity, kind, 'SYNTHESIZED', round(c, 6), NULL, a, '{{"summary_type":"temporal_compression","point_count":' || n || ',"earliest":"' || strftime(a, '%Y-%m-%d %H:%M:%S') || '","latest":"' || strftime(z, '%Y-%m-%d %H:%M:%S') || '"}}' FROM g""")
def memory_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records once old measurements are invalidated by their summaries."""
    x = M.compress_old(observations(spark, sf_dir), T2, T2)
    return x.select("record", "entity", "kind", "method", F.round("confidence", 6).alias("confidence"), "invalidated_by", "valid_from", "summary")


@query(f"WITH {OBS} SELECT entity, kind, count(DISTINCT value) AS n_values, count(*) AS n, min(value) AS lo, max(value) AS hi FROM o WHERE invalidated_by IS NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and kinds whose active values differ."""
    return M.contradictions(observations(spark, sf_dir), ["entity", "kind"])


@query(f"""WITH {OBS}, l AS (SELECT record, invalidated_by AS by_ FROM o WHERE invalidated_by IS NOT NULL)
SELECT record, 0 AS step, by_ AS "by" FROM l UNION ALL SELECT a.record, 1, b.by_ FROM l a JOIN l b ON a.by_ = b.record
UNION ALL SELECT a.record, 2, c.by_ FROM l a JOIN l b ON a.by_ = b.record JOIN l c ON b.by_ = c.record""")
def invalidation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of invalidation of up to three links."""
    return M.chain(observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT b.agent AS src, a.agent AS dst, count(*) AS n FROM o a JOIN o b ON a.invalidated_by = b.record WHERE a.agent <> b.agent GROUP BY 1, 2")
def agent_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which agents overrule which."""
    return M.influence(observations(spark, sf_dir))


@query(f"""WITH {OBS} SELECT entity, kind, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM o
WHERE generated_at BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}' AND invalidated_by IS NULL GROUP BY 1, 2""")
def sliding_window_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of a time window by entity and kind."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return M.active(observations(spark, sf_dir)).filter(F.col("generated_at").between(t(T1), t(T2))).groupBy("entity", "kind").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )


@query(f"""WITH {OBS}, c AS (SELECT count(*) AS total, count(*) FILTER (invalidated_by IS NULL) AS live FROM o)
SELECT total, live, round((total - live) / total * 100, 1) AS reduction FROM c""")
def graph_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of records that invalidation removes."""
    c = observations(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("invalidated_by").isNull()).alias("live"))
    return c.withColumn("reduction", F.round((F.col("total") - F.col("live")) / F.col("total") * 100, 1))


@query(f"""WITH {OBS}, p AS (SELECT *, epoch_us(generated_at) / 1e6 AS at FROM o)
SELECT a.record AS a, b.record AS b, a.entity AS entity, a.kind AS kind FROM p a JOIN p b ON a.entity = b.entity AND a.kind = b.kind AND a.record < b.record
 AND abs(a.at - b.at) < 300 AND abs(a.value - b.value) > 0.1 * a.value""")
def kpi_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation pairs of one entity and kind within five minutes that differ by a tenth."""
    o = observations(spark, sf_dir).withColumn("at", seconds("generated_at"))
    return C.kpi_pairs(o, ["entity", "kind"], "at", "value", 300.0, 0.1).select("a", "b", "entity", "kind")


@query(f"""WITH {OBS}, p AS (SELECT *, epoch_us(generated_at) / 1e6 AS at, CASE method WHEN 'MEASURED' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'IMPORTED' THEN 2 WHEN 'SYNTHESIZED' THEN 3 ELSE 4 END AS pr FROM o),
c AS (SELECT a.record AS a, b.record AS b, a.pr AS pa, b.pr AS pb FROM p a JOIN p b ON a.entity = b.entity AND a.kind = b.kind AND a.record < b.record
 AND abs(a.at - b.at) < 300 AND abs(a.value - b.value) > 0.1 * a.value)
SELECT a, b, CASE WHEN pb < pa THEN b ELSE a END AS winner FROM c""")
def conflict_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner of each conflict by how its value was derived."""
    o = observations(spark, sf_dir).withColumn("at", seconds("generated_at"))
    return C.resolve(C.kpi_pairs(o, ["entity", "kind"], "at", "value", 300.0, 0.1))


@query(f"""WITH {OBS}, m AS (SELECT * FROM o WHERE method = 'MEASURED' AND invalidated_by IS NULL AND value IS NOT NULL)
SELECT a.entity AS entity, a.record AS record_a, b.record AS record_b, CAST(a.value AS VARCHAR) AS value_a, CAST(b.value AS VARCHAR) AS value_b, 'MEASURED_CONTRADICTION' AS conflict_type
FROM m a JOIN m b ON a.entity = b.entity AND a.record < b.record AND a.value <> b.value""")
def memory_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict records of measurements that contradict each other."""
    x = M.escalate(observations(spark, sf_dir), T2)
    return x.select("entity", "record_a", "record_b", "value_a", "value_b", "conflict_type")
