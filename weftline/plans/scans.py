"""Scans of log formats, routing, dictionary matches and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.functions import text as T
from weftline.operators import gates as G
from weftline.operators import graph
from weftline.operators import review as V
from weftline.session import table
from weftline.sources import logs

LEVELS = ("ERROR", "WARN", "INFO", "DEBUG")
LEVEL = "(['ERROR', 'WARN', 'INFO', 'DEBUG'])[event_id % 4 + 1]"
CONF = f"CASE {LEVEL} WHEN 'ERROR' THEN 0.85 WHEN 'WARN' THEN 0.70 WHEN 'INFO' THEN 0.55 ELSE 0.35 END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("level", level)


@query(f"""SELECT event_id, event_type AS message, {LEVEL} AS severity, concat('h', user_id % 9) AS host, concat('u', user_id) AS app, CAST(user_id AS DOUBLE) AS value, 'ms' AS unit,
 {CONF}::DOUBLE AS confidence FROM events WHERE event_id % 7 <> 0""")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with an empty first key, as records; broken lines are dropped."""
    raw = F.format_string('{"message": "", "msg": "%s", "level": "%s", "service": "u%d", "hostname": "h%d", "count": %d, "unit": "ms"}',
                          "event_type", F.lower("level"), "user_id", F.col("user_id") % 9, "user_id")
    raw = F.when(F.col("event_id") % 7 == 0, F.substring(raw, 1, 40)).otherwise(raw)
    x = logs.parse(_events(spark, sf_dir).select("event_id", raw.alias("raw")), "jsonl")
    return x.select("event_id", "message", "severity", "host", "app", "value", "unit", "confidence")


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN concat('plain ', event_type) ELSE event_type END AS message, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 8 AS VARCHAR) END AS severity,
 CASE event_id % 3 WHEN 2 THEN NULL ELSE concat('h', user_id % 9) END AS host, CASE event_id % 3 WHEN 1 THEN '7' WHEN 0 THEN '1' END AS pid,
 CASE event_id % 3 WHEN 0 THEN ([1.0, 1.0, 0.95, 0.9, 0.75, 0.6, 0.5, 0.35])[event_id % 8 + 1] WHEN 1 THEN 0.55 ELSE 0.4 END::DOUBLE AS confidence FROM events""")
def syslog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog lines of both kinds and plain ones, as records."""
    k = F.col("event_id") % 3
    new = F.format_string("<%d>1 2024-01-01T00:00:00Z h%d app 1 id %s", F.col("event_id") % 8 + 8, F.col("user_id") % 9, "event_type")
    old = F.format_string("Jan  2 03:04:05 h%d app[7]: %s", F.col("user_id") % 9, "event_type")
    raw = F.when(k == 0, new).when(k == 1, old).otherwise(F.concat(F.lit("plain "), "event_type"))
    x = logs.parse(_events(spark, sf_dir).select("event_id", raw.alias("raw")), "syslog")
    return x.select("event_id", "message", "severity", "host", "pid", "confidence")


@query("""SELECT event_id, event_type AS message, CAST(event_id % 12 AS VARCHAR) AS severity, concat('t', event_id) AS timestamp, 'two' AS host,
 coalesce(([0.3, 0.35, 0.4, 0.55, 0.6, 0.7, 0.75, 0.85, 0.9, 1.0, 1.0])[event_id % 12 + 1], 0.5)::DOUBLE AS confidence FROM events""")
def cef_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CEF lines behind a syslog prefix, as records."""
    raw = F.format_string("Jan 2 host CEF:0|v|p|1|sig|%s|%d|src=1 end=t%d shost=one dhost=two msg=two words", "event_type", F.col("event_id") % 12, "event_id")
    x = logs.parse(_events(spark, sf_dir).select("event_id", raw.alias("raw")), "auto")
    return x.select("event_id", "message", "severity", "timestamp", "host", "confidence")


@query("""SELECT event_id, CASE event_id % 2 WHEN 0 THEN event_type ELSE 'kind' END AS message, 'INFO' AS severity, (user_id * 1000)::DOUBLE / 1e6 AS value, 'ms' AS unit, 0.8::DOUBLE AS confidence FROM events""")
def otlp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their duration, told from other JSON."""
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"name": "'), "event_type", F.lit('"'))).otherwise('"kind": "kind"')
    raw = F.format_string('{"traceId": "%d", %s, "startTimeUnixNano": "1000", "endTimeUnixNano": "%d"}', "event_id", name, F.col("user_id") * 1000 + 1000)
    x = logs.parse(_events(spark, sf_dir).select("event_id", raw.alias("raw")), "auto")
    return x.select("event_id", "message", "severity", "value", "unit", "confidence")


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'observation' WHEN {LEVEL} = 'ERROR' THEN 'event' WHEN event_type IN ('click', 'error') THEN 'observation' ELSE 'rejected' END AS route FROM events""")
def log_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation, event or rejection of each record."""
    x = _events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("message"), F.when(F.col("event_id") % 3 == 0, F.lit(1.0)).alias("value"), F.col("level").alias("severity"))
    return logs.route(x, ["click", "error"]).select("event_id", "route")


TERMS = ("idiot", "clown", "the", "la", "der")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in TERMS) + " END AS hit FROM documents")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First term of an ordered dictionary that a text holds."""
    out = F.lit(None).cast("string")
    for t in reversed(TERMS):
        out = F.when(F.lower("text").contains(t), t).otherwise(out)
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("hit"))


@query("""SELECT DISTINCT event_type AS source, upper(event_type[1]) || event_type[2:] || 'Event' AS cls FROM events WHERE event_type NOT IN ('other', 'unknown', '')""")
def event_subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes from distinct event types, without junk."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct().filter(~F.col("source").isin("other", "unknown", ""))
    return e.withColumn("cls", F.concat(T.camel_case(F.col("source")), F.lit("Event")))


@query("""WITH q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'open' END AS status, p_size AS evidence FROM part WHERE p_size <= 30),
f AS (SELECT p_partkey AS id, p_size + 100 AS evidence FROM part WHERE p_size >= 20)
SELECT coalesce(q.id, f.id) AS id, coalesce(status, 'open') AS status, CASE WHEN coalesce(status, 'open') = 'open' THEN coalesce(f.evidence, q.evidence) ELSE q.evidence END AS evidence FROM q FULL JOIN f ON q.id = f.id""")
def proposal_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review queue after new evidence."""
    p = table(spark, sf_dir, "part")
    q = p.filter("p_size <= 30").select(
        F.col("p_partkey").alias("proposal_id"), F.when(F.col("p_partkey") % 3 == 0, "approved").otherwise("open").alias("status"), F.col("p_size").alias("evidence"))
    f = p.filter("p_size >= 20").select(F.col("p_partkey").alias("proposal_id"), (F.col("p_size") + 100).alias("evidence"))
    return V.upsert(q, f).withColumnRenamed("proposal_id", "id")


@query("""WITH x AS (SELECT least(value / 100, 0.999) AS p, CAST(event_id % 3 = 0 AS INT) AS y FROM events), g AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM x GROUP BY 1)
SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM g""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error of scores against outcomes."""
    x = table(spark, sf_dir, "events").select(F.least(F.col("value") / 100, F.lit(0.999)).alias("p"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))
    return V.calibration_error(x, "p", "y")


@query("""WITH c AS (SELECT event_type, hour(ts) AS h, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2),
p AS (SELECT event_type, greatest(a / sum(a) OVER (PARTITION BY event_type), 1e-9) AS p, greatest(b / sum(b) OVER (PARTITION BY event_type), 1e-9) AS q FROM c)
SELECT event_type, round(sum(p * log2(p / q)), 6) AS kl, round((sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) / 2, 6) AS js FROM p GROUP BY 1""")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of two samples' distributions over the hours."""
    c = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(
        F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    return V.divergence(c, "event_type", "a", "b")


@query("""SELECT event_id, event_type, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) * 6 / count(*) OVER (PARTITION BY event_type)) AS INT) AS slice FROM events""")
def ordinal_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ordinal windows of each type's events."""
    return V.slices(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 6).select("event_id", "event_type", "slice")


@query("""WITH g AS (SELECT lang AS cls, source AS key, count(*) AS n FROM documents GROUP BY 1, 2), e AS (SELECT DISTINCT lang AS cls FROM documents), r(key, least) AS (VALUES ('src0', 20), ('src1', 5), ('src99', 1))
SELECT cls, key, coalesce(n, 0) AS n FROM e CROSS JOIN r LEFT JOIN g USING (cls, key) WHERE coalesce(n, 0) < least""")
def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes whose answers lack required parts."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("cls"), F.col("source").alias("key"))
    return V.output_gate(d, {"src0": 20, "src1": 5, "src99": 1})


@query("""SELECT concat('part/', p_partkey) AS s, 'flag' AS p, 'large' AS o FROM part WHERE p_size >= 40 AND p_retailprice > 100 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22', 'Brand#31')
 AND regexp_matches(p_type, '^[A-Z]') AND p_name IS NOT NULL""")
def slot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that a rule over slots derives."""
    x = table(spark, sf_dir, "part").withColumn("iri", F.concat(F.lit("part/"), "p_partkey"))
    brands = [f"Brand#{n}" for n in (11, 12, 21, 22, 31)]
    return G.slot_rule(x, [("p_size", ">=", 40), ("p_retailprice", ">", 100), ("p_brand", "in", brands), ("p_type", "regex", "^[A-Z]"), ("p_name", "not_null")],
                       ("flag", "large"), "iri")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS a, p_type AS b, p_size >= 25 AS new FROM part), o AS (SELECT a, b FROM e WHERE NOT new), n AS (SELECT a, b FROM e WHERE new)
SELECT a, b, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT a, b, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived pairs that one version has and the other hasn't."""
    p = table(spark, sf_dir, "part")
    side = lambda c: graph.closure(p.filter(c).select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct()).select("a", "b")
    old, new = side("p_size < 25"), side("p_size >= 25")
    return new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


@query("""SELECT label, count(*) AS n FROM embeddings WHERE label IN (0, 1, 2, 5) AND label IN (1, 5, 7) GROUP BY 1""")
def class_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in both of two class sets."""
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "label int")
    both = s(0, 1).union(s(2, 5)).distinct().intersect(s(1, 5, 7))
    return table(spark, sf_dir, "embeddings").join(F.broadcast(both), "label", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT text AS iri, count(DISTINCT source) AS modules FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def iri_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that several modules define (texts in several sources)."""
    x = table(spark, sf_dir, "documents").groupBy(F.col("text").alias("iri")).agg(F.countDistinct("source").alias("modules"))
    return x.filter("modules > 1")
