"""Mining queries over events and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.functions import text as T
from weftline.operators import mining as M
from weftline.operators.graph import cut
from weftline.operators.range_join import seconds
from weftline.session import table, written


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mined records: the entity is the type, a trace is a user's day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rid"), F.col("event_type").alias("entity"), "ts", seconds("ts").alias("at"),
        F.concat_ws("|", F.col("user_id"), F.to_date("ts")).alias("trace"), "user_id", "value", "props",
    )


REC = """rec AS (SELECT event_id AS rid, event_type AS entity, ts, epoch_us(ts) / 1e6 AS at,
  concat(user_id, '|', CAST(ts AS DATE)) AS trace, user_id, value, props FROM events)"""


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mined records with slots: the type, the user as a name with a prefix, and a number."""
    return records(spark, sf_dir).select(
        "rid", "at", "trace", F.col("entity").alias("cluster_id"),
        F.array("entity", F.concat(F.lit("user:u"), "user_id"), F.get_json_object("props", "$.k")).alias("slots"),
    )


ENTITIES = f"""{REC}, ent AS (SELECT rec.rid, rec.at, rec.trace, unnest([entity, 'user:u' || user_id]) AS v FROM rec),
n AS (SELECT count(DISTINCT rid) AS n FROM ent), m AS (SELECT v, count(DISTINCT rid) AS c FROM ent GROUP BY 1),
tr AS (SELECT DISTINCT trace, v FROM ent),
co AS (SELECT src, dst, CAST(sum(k) AS BIGINT) AS cooc FROM (
  SELECT a.v AS src, b.v AS dst, count(*) AS k FROM tr a JOIN tr b ON a.trace = b.trace AND a.v < b.v GROUP BY 1, 2 UNION ALL
  SELECT least(a.v, b.v), greatest(a.v, b.v), count(*) FROM ent a JOIN ent b ON a.rid < b.rid AND a.v <> b.v AND abs(a.at - b.at) <= 60 GROUP BY 1, 2) GROUP BY 1, 2),
pmi AS (SELECT src, dst, cooc, round(log2((cooc / n) / ((x.c / n) * (y.c / n))), 6) AS pmi FROM co JOIN m x ON src = x.v JOIN m y ON dst = y.v CROSS JOIN n),
edges AS (SELECT * FROM pmi WHERE pmi >= 2)"""


def entity_edges(spark: SparkSession, sf_dir: str, slots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of the events with their entities, and the PMI edges of these with their lead ratio."""
    x = extractions(spark, sf_dir)
    rec, unique = M.record_entities(x, M.slot_profiles(x) if slots is None else slots, "rid", "at", "trace")
    rec = written(rec, "records")  # traces, windows and marginals read them
    return rec, M.entity_edges(rec, unique)


@query(f"WITH {ENTITIES} SELECT src, dst, cooc, pmi FROM edges")
def pmi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PMI of slot values that share a trace or lie within a minute."""
    return entity_edges(spark, sf_dir)[1].drop("lead")


@query(f"""WITH {ENTITIES}, t AS (SELECT DISTINCT ent.v, ent.rid, ent.at FROM ent),
l AS (SELECT e.src, e.dst, e.pmi, e.cooc, round(count(*) FILTER (a.at < b.at) / nullif(count(*) FILTER (a.at <> b.at), 0), 6) AS lead
  FROM edges e LEFT JOIN (t a JOIN t b ON abs(a.at - b.at) <= 60 AND a.v < b.v) ON a.v = e.src AND b.v = e.dst GROUP BY ALL)
SELECT CASE WHEN lead <= 0.3 THEN dst ELSE src END AS src, CASE WHEN lead <= 0.3 THEN src ELSE dst END AS dst, cooc, pmi,
 round(CASE WHEN lead <= 0.3 THEN 1 - lead ELSE lead END, 6) AS lead, coalesce(lead <= 0.3 OR lead >= 0.7, false) AS directed FROM l""")
def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PMI edges with their lead ratio, turned so that a directed one runs from first to second."""
    return M.directed(entity_edges(spark, sf_dir)[1])


@query(f"""
WITH {REC}
SELECT least(a.entity, b.entity) AS src, greatest(a.entity, b.entity) AS dst, count(*) AS cooc
FROM rec a JOIN rec b ON a.rid < b.rid AND a.entity <> b.entity AND abs(a.at - b.at) <= 60 GROUP BY 1, 2""")
def window_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type pairs of two records within a minute."""
    return M.window_pairs(records(spark, sf_dir), 60.0)


@query(f"""
WITH {REC}, g AS (SELECT a.entity AS src, b.entity AS dst, count(*) FILTER (a.at < b.at) AS f, count(*) FILTER (a.at > b.at) AS s
FROM rec a JOIN rec b ON a.entity < b.entity AND abs(a.at - b.at) <= 60 GROUP BY 1, 2)
SELECT src, dst, round(f / nullif(f + s, 0), 6) AS lead,
 CASE WHEN round(f / nullif(f + s, 0), 6) >= 0.7 THEN 'forward' WHEN round(f / nullif(f + s, 0), 6) <= 0.3 THEN 'backward'
 WHEN f + s > 0 THEN 'undirected' END AS direction FROM g""")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal direction of type pairs within a minute."""
    return M.lead_ratio(records(spark, sf_dir), 60.0)


@query("SELECT event_type AS entity, count(*) AS records, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def marginal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and users of each entity."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity")).agg(
        F.count("*").alias("records"), F.countDistinct("user_id").alias("users")
    )


@query(r"""
WITH c AS (SELECT event_type AS cluster, unnest([0, 1, 2, 3, 4]) AS slot,
  unnest([event_type, 'user:u' || user_id, json_extract_string(props, '$.k'), CASE WHEN user_id % 3 > 0 THEN event_id || 'e-3' ELSE '' END, 'imsi-' || user_id % 40]) AS v FROM events),
k AS (SELECT cluster, slot, v, count(*) AS k FROM c WHERE v <> '' GROUP BY ALL),
top AS (SELECT cluster, slot, list(v ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cluster, slot ORDER BY k DESC, v) AS r FROM k) WHERE r <= 5 GROUP BY 1, 2),
g AS (SELECT cluster, slot, count(v) AS n, count(DISTINCT v) AS n_distinct,
  avg(CAST(regexp_matches(v, '^(?:https?|urn|ftp):\S+$|^[A-Za-z][\w-]*:[A-Za-z][\w-]*$') AS INT)) AS iri, avg(CAST(regexp_matches(v, '^\d{1,3}(?:\.\d{1,3}){3}$') AS INT)) AS ip,
  avg(CAST(regexp_matches(v, '^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$') AS INT)) AS uuid,
  avg(CAST(regexp_matches(v, '^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$') AS INT)) AS num, avg(CAST(regexp_matches(v, '^(?:0x)?[0-9a-fA-F]{8,}$') AS INT)) AS hex
  FROM c WHERE v <> '' GROUP BY 1, 2)
SELECT cluster, slot, n, n_distinct, array_to_string(top, '|') AS top_values, regexp_matches(array_to_string(top, '|'), '(?i)imsi|msisdn|email|ssn|tax') AS pii_risk, CASE WHEN iri >= .8 THEN 'IRI' WHEN ip >= .8 THEN 'IP' WHEN uuid >= .8 THEN 'UUID'
  WHEN n_distinct <= 8 AND n_distinct < n THEN 'ENUM' WHEN num >= .8 THEN 'NUMERIC' WHEN hex >= .8 THEN 'HEX' ELSE 'FREETEXT' END AS slot_type FROM g JOIN top USING (cluster, slot)""")
def slot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the events' slots by the type ladder; empty values don't count."""
    number = F.when(F.col("user_id") % 3 > 0, F.concat("event_id", F.lit("e-3"))).otherwise("")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cluster_id"),
        F.array("event_type", F.concat(F.lit("user:u"), "user_id"), F.get_json_object("props", "$.k"), number,
                F.concat(F.lit("imsi-"), F.col("user_id") % 40)).alias("slots"),
    )
    return M.slot_profiles(e).withColumnRenamed("cluster_id", "cluster").withColumn("top_values", F.array_join("top_values", "|"))


@query(r"""
WITH c AS (SELECT event_type AS cluster, json_extract_string(props, '$.k') AS v, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS rank FROM c WHERE v IS NOT NULL)
SELECT cluster, v, n, rank FROM r WHERE rank <= 5""")
def slot_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most common values of a slot for each cluster."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("cluster"), F.get_json_object("props", "$.k").alias("v"))
    return M.top_values(e.filter("v is not null"), ["cluster"], "v")


@query("""
WITH s AS (SELECT event_type, CASE WHEN value < 10 THEN 'low' ELSE 'high' END AS sev, ts FROM events),
n AS (SELECT event_type, sev, count(*) AS n, min(ts) AS t0 FROM s GROUP BY 1, 2),
m AS (SELECT event_type, sev, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, t0, sev) AS k FROM n)
SELECT s.event_type AS cluster_id, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen, any_value(m.sev) AS modal_severity,
  s.event_type AS modal_service FROM s JOIN m ON s.event_type = m.event_type AND k = 1 GROUP BY s.event_type""")
def template_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, first and last time, modal severity and service of each cluster."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cluster_id"), F.col("event_type").alias("service"),
        F.when(F.col("value") < 10, "low").otherwise("high").alias("severity"), "ts",
    )
    return M.template_stats(e)


@query()
def template_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of conversation lines: (template, hits), order-independent."""
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("message"))
    return M.templates(lines.filter("message != ''")).groupBy("template").agg(F.count("*").alias("hits"))


@query()
def busiest_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten templates of conversation lines with most records."""
    lines = table(spark, sf_dir, "conversations").select(F.col("turn").alias("ts"), F.explode(F.split("text", "\n")).alias("message"))
    return M.busiest_templates(M.templates(lines.filter("message != ''")), 10).drop("cluster_id")


def _masked_sql(column: str) -> str:
    for pattern, name in T.MASKS:
        column = f"regexp_replace({column}, '{pattern}', '{name}', 'g')"
    return column


@query(f"SELECT page_id, {_masked_sql('url')} AS masked FROM pages")
def masked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable parts of URLs masked."""
    return table(spark, sf_dir, "pages").select("page_id", T.mask(F.col("url")).alias("masked"))


@query("""
WITH t AS (SELECT event_type, count(*) AS hits FROM events GROUP BY 1)
SELECT a.event_type AS a, b.event_type AS b, CAST(levenshtein(a.event_type, b.event_type) AS INT) AS distance
FROM t a JOIN t b ON a.event_type < b.event_type AND levenshtein(a.event_type, b.event_type) <= 6""")
def template_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of templates within an edit distance."""
    return M.near_texts(table(spark, sf_dir, "events").select("event_type").distinct(), "event_type", 6)


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS w FROM documents),
n AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM w),
tf AS (SELECT w, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1)
SELECT w AS term, tf, df, round(tf * (ln(n / (df + 1)) + 1), 4) AS score FROM tf, n WHERE df >= 5""")
def entity_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term scores tf * (ln(N / (df + 1)) + 1) over all documents."""
    d = table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), 0)).alias("term"))
    by_doc = w.groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    n = by_doc.agg(F.countDistinct("doc_id").cast("double").alias("n"))
    tf = by_doc.groupBy("term").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).filter("df >= 5")
    return tf.crossJoin(F.broadcast(n)).select(
        "term", "tf", "df", F.round(F.col("tf") * (F.log(F.col("n") / (F.col("df") + 1)) + 1), 4).alias("score")
    )


@query(r"""
WITH s AS (SELECT event_type, list_sort(list_distinct(regexp_extract_all(lower(event_type || ' ' || props), '[a-z_]{2,}'))) AS toks FROM events)
SELECT event_type, substr(sha256(array_to_string(toks, ' ')), 1, 16) AS signature, count(*) AS n FROM s GROUP BY 1, 2""")
def template_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature of sorted distinct tokens."""
    toks = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "event_type", "props")), F.lit("[a-z_]{2,}"), 0)))
    return table(spark, sf_dir, "events").select(
        "event_type", F.substring(F.sha2(F.array_join(toks, " "), 256), 1, 16).alias("signature")
    ).groupBy("event_type", "signature").agg(F.count("*").alias("n"))


@query(f"""WITH {ENTITIES}, t AS (SELECT DISTINCT ent.v, ent.rid, ent.at FROM ent),
l AS (SELECT e.src, e.dst, e.pmi, e.cooc, round(count(*) FILTER (a.at < b.at) / nullif(count(*) FILTER (a.at <> b.at), 0), 6) AS lead
  FROM edges e LEFT JOIN (t a JOIN t b ON abs(a.at - b.at) <= 60 AND a.v < b.v) ON a.v = e.src AND b.v = e.dst GROUP BY ALL),
c AS (SELECT event_type, count(*) AS hits, CASE WHEN avg(value) < 20 THEN 'ERROR' ELSE 'info' END AS sev FROM events GROUP BY 1)
SELECT 'LOG_EVENT' AS proposal_type, 'cluster:' || event_type AS name, 'LOG_TEMPLATE_CLUSTERING' AS strategy, least(0.4 + 0.05 * hits, 1)::DOUBLE AS confidence, least(hits / 50, 1)::DOUBLE AS evidence_volume,
 CASE sev WHEN 'ERROR' THEN 0.8 ELSE 0.2 END::DOUBLE AS evidence_recency, 0::DOUBLE AS cross_domain, 0::DOUBLE AS consistency_risk FROM c WHERE hits >= 3
UNION ALL SELECT 'LOG_ENTITY', event_type || ':' || slot || ':' || kind, 'LOG_TEMPLATE_CLUSTERING', least(0.5 + 0.05 * (hits / 10), 1), least(hits / 20, 1), 0, 0, 0 FROM c, (VALUES (0, 'ENUM'), (1, 'IRI')) s(slot, kind)
UNION ALL SELECT 'LOG_RELATIONSHIP', CASE WHEN lead <= 0.3 THEN dst || '::' || src ELSE src || '::' || dst END, 'PMI_TEMPORAL_ORDERING', round(least(0.4 + (pmi - 3) / 10, 1), 6), least(cooc / 30, 1), 0, round(least(pmi / 10, 1), 6), 0 FROM l WHERE pmi >= 3""")
def seeded_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals from templates, slots and edges, without a causal test."""
    from weftline.operators import review as V

    x = extractions(spark, sf_dir)
    slots = cut(M.slot_profiles(x))
    templates = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cluster_id")).agg(
        F.count("*").alias("hits"), F.when(F.avg("value") < 20, "ERROR").otherwise("info").alias("severity"))
    got = V.seed(templates, slots, M.directed(entity_edges(spark, sf_dir, slots)[1]))
    return got.select(*[F.round(c, 6).alias(c) if c not in ("proposal_type", "name", "strategy") else c for c in V.SEED])
