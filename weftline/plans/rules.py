"""Gates, policies, drift and quality rules over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.operators import gates as G
from weftline.plans.memory import OBS, observations
from weftline.session import table

MAPPING = G.Mapping(
    {"Customer": "customer"},
    {"Customer": {
        "hasName": ("c_name", "Public"), "segment": ("c_mktsegment", "Internal"), "key": ("c_custkey", "Public"),
        "balance": ("c_acctbal", "Confidential"),
    }},
)


@query("SELECT c_custkey, c_mktsegment, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey >= 10 ORDER BY c_custkey")
def plan_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validated plan: columns within the tier, filters as expressions."""
    plan = G.Plan("Customer", [("segment", "=", "BUILDING"), ("key", ">=", 10)], limit=1 << 30)
    return G.compile_plan(plan, MAPPING, {"customer": table(spark, sf_dir, "customer")}, "Internal")


@query(f"""WITH {OBS}, g AS (SELECT record, CASE WHEN value IS NULL THEN ['missing value'] ELSE [] END || CASE WHEN coalesce(confidence, -1) < 0.3 THEN ['confidence below minimum'] ELSE [] END
 || CASE WHEN method NOT IN ('MEASURED', 'INFERRED', 'IMPORTED') THEN ['invalid derivation'] ELSE [] END AS reasons FROM o)
SELECT record, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS accepted FROM g""")
def input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected records with all reasons."""
    x = G.input_gate(observations(spark, sf_dir), ["record", "value"], 0.3, ("MEASURED", "INFERRED", "IMPORTED"))
    return x.select("record", F.array_join("reasons", ";").alias("reasons"), "accepted")


@query(f"""WITH {OBS}, r AS (SELECT 'confidence below minimum' AS reason FROM o WHERE confidence < 0.3 UNION ALL SELECT 'invalid derivation' FROM o WHERE method = 'SYNTHESIZED' UNION ALL SELECT 'missing value' FROM o WHERE value IS NULL)
SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 6) AS rate FROM r GROUP BY 1""")
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections by reason."""
    return G.reject_summary(G.input_gate(observations(spark, sf_dir), ["record", "value"], 0.3, ("MEASURED", "INFERRED", "IMPORTED")))


@query(f"""WITH {OBS} SELECT record, CASE WHEN confidence >= 0.8 AND method IN ('MEASURED') THEN 'approve' WHEN confidence < 0.2 THEN 'reject' ELSE 'review' END AS action FROM o""")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching policy of each record."""
    return G.decide(observations(spark, sf_dir), [
        ("sure", "confidence >= 0.8 and method in (MEASURED)", "approve"), ("old", "REVOKED:confidence > 0", "approve"), ("weak", "confidence < 0.2", "reject"),
    ]).select("record", "action")


@query("""SELECT vec_id, array_to_string(list_filter([CASE WHEN label % 4 = 3 THEN 'restricted' END, CASE WHEN label % 4 > 1 THEN 'tier above cap' END, CASE WHEN label NOT IN (0, 1, 2, 3) THEN 'class not allowed' END,
 CASE WHEN vec_id % 3 <> 0 THEN 'attribution mismatch' END], lambda x: x IS NOT NULL), ';') AS reasons FROM embeddings""")
def federation_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with every reason that keeps them from crossing."""
    tiers = F.array(*[F.lit(t) for t in ("Public", "Internal", "Confidential", "Restricted")])
    x = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("cls"), F.element_at(tiers, (F.col("label") % 4 + 1).cast("int")).alias("tier"),
        F.concat(F.lit("agent"), F.col("vec_id") % 3).alias("agent"),
    )
    return G.boundary(x, "Internal", ["0", "1", "2", "3"], "agent0").select("vec_id", F.array_join("reasons", ";").alias("reasons"))


PROPOSALS = """p AS (SELECT DISTINCT p_type AS proposal_id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE split_part(p_type, ' ', 1) || ' \u2014 seen' END AS title,
  (['NEW_CLASS', 'NEW_PROPERTY', 'NEW_CONSTRAINT', 'DEPRECATE', 'OTHER'])[p_size % 5 + 1] AS kind, CASE WHEN p_size % 4 = 0 THEN p_size / 50.0 END AS volume FROM part WHERE p_size < 20),
ev AS (SELECT lower(p_type || ' ' || p_brand) AS text, p_brand AS source, TIMESTAMP '2024-01-01' + INTERVAL (p_partkey % 40) DAY AS made FROM part),
w AS (SELECT DISTINCT *, lower(trim(split_part(title, '\u2014', 1))[:40]) AS word FROM p),
seen AS (SELECT word, count(*) AS n, max(ev.made) AS newest, count(DISTINCT source) AS k FROM (SELECT DISTINCT word FROM w WHERE word <> '') JOIN ev ON contains(text, word) GROUP BY 1),
known AS (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT 'standard'),
near AS (SELECT title, max(CASE WHEN contains(lower(title), name) OR contains(name, lower(title)) THEN 0.7 ELSE len(list_intersect(string_split(lower(title), ' '), string_split(name, ' '))) / len(list_distinct(string_split(lower(title), ' ') || string_split(name, ' '))) END) AS near
  FROM (SELECT DISTINCT title FROM p WHERE title <> ''), known GROUP BY 1)"""


@query(f"""WITH {PROPOSALS}, d AS (SELECT proposal_id, kind, w.title,
 CASE WHEN volume > 0 THEN least(volume, 1) WHEN word = '' THEN 0 ELSE least(coalesce(n, 0) / 30, 1) END::DOUBLE AS evidence_volume,
 CASE WHEN word = '' THEN 0.5 WHEN newest IS NULL THEN 0.3 ELSE least(exp(-(epoch(TIMESTAMP '2024-02-15') - epoch(newest)) / 86400.0 / 30.0), 1) END::DOUBLE AS evidence_recency,
 CASE WHEN coalesce(k, 0) = 0 THEN 0.33 ELSE least(k / 3, 1) END::DOUBLE AS cross_domain,
 CASE kind WHEN 'NEW_CLASS' THEN 0.8 WHEN 'NEW_PROPERTY' THEN 0.8 WHEN 'NEW_CONSTRAINT' THEN 0.6 WHEN 'DEPRECATE' THEN 0.4 ELSE 0.5 END::DOUBLE AS consistency_risk,
 CASE WHEN w.title = '' THEN 0.5 ELSE greatest(1 - coalesce(near, 0), 0.3) END::DOUBLE AS schema_alignment FROM w LEFT JOIN seen USING (word) LEFT JOIN near ON near.title = w.title),
s AS (SELECT *, round(evidence_volume * 0.25::DOUBLE + evidence_recency * 0.2::DOUBLE + cross_domain * 0.2::DOUBLE + consistency_risk * 0.2::DOUBLE + schema_alignment * 0.15::DOUBLE, 3) AS score FROM d)
SELECT proposal_id, kind, title, score, CASE WHEN score >= 0.8 THEN 'REVIEW_NOW' WHEN score >= 0.5 THEN 'WEEKLY_BATCH' ELSE 'CANDIDATE' END AS band FROM s""")
def proposal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dimensions of proposals from the evidence for their keyword, their score and band."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    kinds = F.array(*[F.lit(k) for k in (*G.KIND_RISK, "OTHER")])
    p = part.filter("p_size < 20").select(
        F.col("p_type").alias("proposal_id"),
        F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit(" \u2014 seen"))).alias("title"),
        F.element_at(kinds, (size % 5 + 1).cast("int")).alias("kind"), F.when(size % 4 == 0, size / 50.0).alias("volume")).distinct()
    ev = part.select(
        F.concat_ws(" ", "p_type", "p_brand").alias("text"), F.col("p_brand").alias("source"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(p_partkey % 40 as int))").alias("generated_at"))
    known = part.select(F.lower("p_brand").alias("name")).distinct().unionByName(spark.range(1).select(F.lit("standard").alias("name")))
    x = G.proposal_score(G.proposal_dimensions(p, ev, known, "2024-02-15"))
    return x.select("proposal_id", "kind", "title", "score", "band")


HISTORY = """h AS (SELECT (['L10', 'L8', 'L9', 'L11', 'L12'])[k + 1] AS layer, (['ece', 'ari', 'ranker_auc', 'edge_jaccard', 'mean_merge_distance'])[k + 1] AS metric, run, v AS value
 FROM (SELECT event_id % 5 AS k, CAST(ts AS DATE) AS run, round(avg(value) / 100, 4) AS v FROM events GROUP BY 1, 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY run DESC) AS k FROM h), l AS (SELECT layer, metric, list(value ORDER BY run) AS t FROM r WHERE k <= 3 GROUP BY 1, 2)"""


@query(f"""WITH {HISTORY}, a AS (SELECT layer, metric, CASE metric WHEN 'ece' THEN 2 WHEN 'mean_merge_distance' THEN 4 ELSE 3 END AS severity, t[-1] AS value,
 CASE metric WHEN 'ece' THEN 0.05 WHEN 'ari' THEN 0.7 WHEN 'ranker_auc' THEN 0.1 WHEN 'edge_jaccard' THEN 0.6 ELSE 0.15 END::DOUBLE AS threshold,
 CASE metric WHEN 'ece' THEN len(t) >= 3 AND list_min(t) > 0.05 WHEN 'ari' THEN len(t) >= 2 AND t[-1] < 0.7 WHEN 'edge_jaccard' THEN len(t) >= 2 AND t[-1] < 0.6
  WHEN 'ranker_auc' THEN len(t) >= 3 AND list_max(t) - t[-1] > 0.1 ELSE len(t) >= 3 AND t[-1] - t[1] > 0.15 END AS hit FROM l) SELECT layer, metric, severity, value, threshold FROM a WHERE hit""")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of five rules over the last runs of metrics."""
    names = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("metric")) for a, b in G.ALERTS])
    order = [("L10", "ece"), ("L8", "ari"), ("L9", "ranker_auc"), ("L11", "edge_jaccard"), ("L12", "mean_merge_distance")]
    assert list(G.ALERTS) == order
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 5).alias("k"), F.to_date("ts").alias("run")).agg(
        F.round(F.avg("value") / 100, 4).alias("value"))
    h = e.withColumn("n", F.element_at(names, (F.col("k") + 1).cast("int"))).select("n.layer", "n.metric", "run", "value")
    return G.drift_alerts(h).drop("recent")


@query("""SELECT * FROM (SELECT 'T1-RES-STATE-01' AS rule_id, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_size % 3 = 0 AND p_brand LIKE '%1'
UNION ALL SELECT 'T1-ALARM-CLEARED-01', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error' AND event_id % 4 = 0
UNION ALL SELECT 'T1-BILL-DUE-01', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'T1-TICKET-RESOLVE-01', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0)""")
def consistency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the state rules of resources, alarms, bills and tickets."""
    from weftline.operators import conflict

    t = lambda n: table(spark, sf_dir, n)
    stamp = F.lit("2024-01-01").cast("timestamp_ntz")
    return conflict.violations({
        "resource": t("part").select(
            F.col("p_partkey").alias("resource_iri"), F.when(F.col("p_size") % 3 == 0, "Disabled").otherwise("Enabled").alias("operational_state"),
            F.when(F.col("p_brand").endswith("1"), "Unlocked").otherwise("Locked").alias("admin_state")),
        "alarm": t("events").select(
            F.col("event_id").alias("alarm_iri"), F.when(F.col("event_type") == "error", "Cleared").otherwise("Raised").alias("alarm_state"),
            F.when(F.col("event_id") % 4 != 0, stamp).alias("cleared_at")),
        "customer_bill": t("customer").select(
            F.col("c_custkey").alias("bill_number"), F.col("c_acctbal").alias("amount_due"),
            F.when(F.col("c_mktsegment") == "BUILDING", "CreditNote").otherwise("Invoice").alias("bill_type")),
        "trouble_ticket": t("orders").select(
            F.col("o_orderkey").alias("ticket_iri"), F.when(F.col("o_orderstatus") == "F", "Resolved").otherwise("Open").alias("status"),
            F.when(F.col("o_orderkey") % 5 != 0, stamp).alias("resolved_at")),
    })


@query("""WITH k AS (SELECT event_id AS record, user_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events)
SELECT a.user_id AS user_id, a.event_type AS event_type, count(*) AS n, min(a.value) AS lo, max(a.value) AS hi FROM k a JOIN k b ON a.user_id = b.user_id AND a.event_type = b.event_type
 AND a.record <> b.record AND abs(a.t - b.t) < 300 WHERE abs(a.value - b.value) > a.value * 0.1::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 2""")
def measurement_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with conflicting measurements within five minutes."""
    from weftline.operators import conflict
    from weftline.operators.range_join import seconds

    k = table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), "user_id", "event_type", seconds("ts").alias("t"), "value")
    return conflict.measurement_conflicts(k, ["user_id", "event_type"], "t", "value")


@query("""WITH c AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1, 2),
t AS (SELECT *, sum(a) OVER (PARTITION BY event_type) AS sa, sum(b) OVER (PARTITION BY event_type) AS sb FROM c),
p AS (SELECT event_type, greatest(a / sa, 1e-4) AS x, greatest(b / sb, 1e-4) AS y FROM t)
SELECT event_type, round(sum((y - x) * ln(y / x)), 6) AS psi, CASE WHEN sum((y - x) * ln(y / x)) > 0.25 THEN 'CRITICAL' WHEN sum((y - x) * ln(y / x)) > 0.1 THEN 'WARNING' ELSE 'OK' END AS level FROM p GROUP BY 1""")
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability index of a value's distribution between two halves of a month."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    c = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 10).cast("long").alias("bin")).agg(
        F.count_if(F.col("ts") < cut).alias("a"), F.count_if(F.col("ts") >= cut).alias("b"))
    w = W.partitionBy("event_type")
    part = G.psi(F.col("a") / F.sum("a").over(w), F.col("b") / F.sum("b").over(w))
    x = c.withColumn("part", part).groupBy("event_type").agg(F.sum("part").alias("p"))
    return x.select("event_type", F.round("p", 6).alias("psi"), G.drift_level(F.col("p")).alias("level"))


@query("""WITH m AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM m)
SELECT event_type, count(*) AS runs, count(*) FILTER (n > 60) AS breaches, count(*) FILTER (n > 60) = 3 AS alert FROM r WHERE k <= 3 GROUP BY 1""")
def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics whose last three runs all breach a limit."""
    m = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    last = m.withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("day")))).filter("k <= 3")
    return last.groupBy("event_type").agg(
        F.count("*").alias("runs"), F.count_if(F.col("n") > 60).alias("breaches"), (F.count_if(F.col("n") > 60) == 3).alias("alert"))


@query("""WITH v AS (SELECT source, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, yes, no, round(coalesce(yes / nullif(yes + no, 0), 0.5), 6) AS prior, CASE WHEN yes + no >= 5 AND yes / (yes + no) >= 0.9 THEN 'approve' WHEN yes + no >= 5 AND yes / (yes + no) <= 0.1 THEN 'reject' ELSE 'review' END AS auto FROM v""")
def library_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior from earlier decisions, and what may be decided without review."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    v = x.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("yes"), F.count_if(F.col("quality") == 0).alias("no"))
    n = F.col("yes") + F.col("no")
    share = F.col("yes") / n
    return v.select("source", "yes", "no", F.round(F.coalesce(F.when(n > 0, share), F.lit(0.5)), 6).alias("prior"),
                    F.when((n >= 5) & (share >= 0.9), "approve").when((n >= 5) & (share <= 0.1), "reject").otherwise("review").alias("auto"))


@query("""WITH f AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS inbound, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS outbound FROM nation)
SELECT k, inbound, outbound, CASE WHEN inbound = 0 AND outbound = 0 THEN 'ORPHAN' WHEN inbound = 0 THEN 'ISOLATED_SOURCE' WHEN outbound = 0 THEN 'ISOLATED_SINK' ELSE 'CONNECTED' END AS kind FROM f""")
def orphan_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rows are linked, from two grouped counts."""
    i = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("i"))
    o = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("o"))
    x = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).join(i, "k", "left").join(o, "k", "left").fillna(0, ["i", "o"])
    kind = F.when((F.col("i") == 0) & (F.col("o") == 0), "ORPHAN").when(F.col("i") == 0, "ISOLATED_SOURCE").when(
        F.col("o") == 0, "ISOLATED_SINK").otherwise("CONNECTED")
    return x.select("k", F.col("i").alias("inbound"), F.col("o").alias("outbound"), kind.alias("kind"))


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day as a trajectory of its cohort: (service, trace, symbols, times)."""
    from weftline.operators import sequences as S

    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("cohort"), F.col("user_id") % 8).alias("service"), F.concat_ws("|", F.col("user_id"), F.to_date("ts")).alias("trace"),
        "ts", "event_type", "event_id")
    return S.trajectories(e, ["service", "trace"], "ts", "event_type", 4, "event_id")


@query()
def trajectory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov scores of each user's days, by cohort."""
    from weftline.operators import sequences as S

    return S.score_trajectories(_cohorts(spark, sf_dir), "service")


@query()
def regime_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day with its regime (mixtures of up to three) and whether it is unusual there."""
    from weftline.operators import hmm

    return hmm.regime_anomalies(_cohorts(spark, sf_dir), "service", most=3, restarts=1, rounds=15).drop("regimes")


@query()
def global_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes of eight windows of time that all cohorts share."""
    from weftline.operators import hmm

    t = _cohorts(spark, sf_dir).withColumn("at", F.col("times")[0])
    return hmm.two_levels(t, "service", "at", 2, 8, 4, most=1, restarts=1, rounds=8)[0]


@query()
def variational_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure it is, over a posterior of models, that a user's day lies below its cohort's threshold."""
    from weftline.operators import hmm

    return hmm.variational_confidence(_cohorts(spark, sf_dir), "service", sizes=(2, 3), restarts=1, rounds=15)


@query("""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id, event_type) AS p FROM events),
k AS (SELECT * FROM x WHERE p IS NULL OR p <> event_type)
SELECT user_id, day, string_agg(event_type, ',' ORDER BY ts, event_id) AS symbols FROM k GROUP BY 1, 2 HAVING count(*) >= 4""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a user's day without repeats."""
    from weftline.operators import sequences as S

    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_type", "event_id")
    return S.trajectories(e, ["user_id", "day"], "ts", "event_type", 4, "event_id").select("user_id", "day", F.array_join("symbols", ",").alias("symbols"))


@query()
def attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day under a next-symbol model of its cohort: the least likely event and what the model looked at."""
    from weftline.operators import attention

    return attention.attention_scores(_cohorts(spark, sf_dir), "service", rounds=20)
