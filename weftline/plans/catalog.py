"""Catalogue, target and model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.operators import catalog_rules as R
from weftline.operators import gates as G
from weftline.operators import graph, models
from weftline.operators import sequences as S
from weftline.operators.mining import directed
from weftline.operators.series import hourly_counts
from weftline.plans.graph import triples
from weftline.plans.mining import ENTITIES, entity_edges
from weftline.session import table
from weftline.sources import sinks, tables

NAMES = ("customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
#: The star schema's foreign keys.
FOREIGN = (
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"),
    ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"), ("labels", "doc_id", "documents"),
)
COLS = f"cols AS (SELECT table_name, lower(column_name) AS column_name FROM duckdb_columns() WHERE table_name IN {NAMES})"
KEYS = "fk(table_name, column_name, target) AS (VALUES " + ", ".join(map(str, FOREIGN)) + ")"


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.columns_of({n: table(spark, sf_dir, n) for n in NAMES})
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean")


def foreign(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FOREIGN), "table_name string, column_name string, target string")


@query(f"""WITH {COLS}, b AS (SELECT table_name, bool_or(regexp_matches(column_name, '(_at|_ts|date|time|^ts)$')) AS timed, bool_or(regexp_matches(column_name, 'source|ref')) AS sourced,
 bool_or(regexp_matches(column_name, 'unit')) AS unit, bool_or(regexp_matches(column_name, 'name|label|title|desc')) AS described, bool_or(regexp_matches(column_name, 'value|amount|balance|price')) AS valued FROM cols GROUP BY 1)
SELECT 'STATUS_AS_EVENT' AS rule, table_name, column_name FROM cols WHERE regexp_matches(column_name, '(status|state|flag)$')
UNION ALL SELECT 'IMPLICIT_ACTOR', table_name, column_name FROM cols WHERE regexp_matches(column_name, '(_by|user_id|owner|custkey)$')
UNION ALL SELECT 'OVERLOADED_TYPE', table_name, column_name FROM cols WHERE regexp_matches(column_name, '(type|kind|category)$')
UNION ALL SELECT 'MISSING_TIMESTAMP', table_name, '*' FROM b WHERE NOT timed UNION ALL SELECT 'FLOATING_VALUE', table_name, '*' FROM b WHERE valued AND NOT unit
UNION ALL SELECT 'MISSING_SOURCE_REF', table_name, '*' FROM b WHERE NOT sourced UNION ALL SELECT 'MISSING_METADATA', table_name, '*' FROM b WHERE NOT described""")
def schema_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the schema loses, by seven rules."""
    return R.losses(columns(spark, sf_dir))


@query(f"""WITH {COLS}, {KEYS}, k AS (SELECT table_name, count(*) AS keys, count(DISTINCT target) AS targets FROM fk GROUP BY 1), n AS (SELECT table_name, count(*) AS n FROM cols GROUP BY 1)
SELECT table_name, keys, n FROM k JOIN n USING (table_name) WHERE targets >= 2 AND n - keys <= 3""")
def junction_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that only link others."""
    return R.junctions(foreign(spark), columns(spark, sf_dir))


@query(f"""WITH RECURSIVE {KEYS}, p AS (SELECT DISTINCT table_name AS start, target AS stop, [table_name, target] AS path, 1 AS steps FROM fk
UNION ALL SELECT p.start, fk.target, list_append(path, fk.target), steps + 1 FROM p JOIN fk ON fk.table_name = p.stop WHERE steps < 4 AND NOT list_contains(path, fk.target))
SELECT start, stop, array_to_string(path, '>') AS path, steps FROM p""")
def key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of foreign keys."""
    return R.key_paths(foreign(spark)).select("start", "stop", F.array_join("path", ">").alias("path"), "steps")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS keys, max(n) AS most, round(avg(n), 6) AS mean, CASE WHEN max(n) = 1 THEN '1:1' ELSE '1:n' END AS cardinality FROM n""")
def key_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a child for each parent."""
    return R.cardinality(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""WITH a AS (SELECT p_name AS old, p_brand || p_type AS signature, row_number() OVER (PARTITION BY p_brand || p_type ORDER BY p_name) AS k FROM part WHERE p_size <= 25),
b AS (SELECT p_name AS new, p_brand || p_type AS signature, row_number() OVER (PARTITION BY p_brand || p_type ORDER BY p_name) AS k FROM part WHERE p_size > 25)
SELECT old, new, signature FROM a JOIN b USING (signature, k)""")
def rename_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed and added names that share a signature, first to first."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat("p_brand", "p_type").alias("signature"), "p_size")
    side = lambda c: p.filter(c).select("name", "signature")
    return R.renames(side("p_size <= 25"), side("p_size > 25"))


@query("""WITH h AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000)
SELECT n_nationkey AS k, (SELECT round(avg(CASE WHEN n.n_nationkey IN (SELECT k FROM h) THEN 1 ELSE 0 END), 6) FROM nation n) AS share FROM nation WHERE n_nationkey NOT IN (SELECT k FROM h)""")
def compliance_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required elements without evidence, with the share that has it."""
    need = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return R.coverage(need, table(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")), "k")


@query("""WITH t AS (SELECT DISTINCT p_partkey AS rule, unnest(regexp_extract_all(p_brand || ' ' || p_type, '\\w+')) AS cls FROM part)
SELECT rule, cls FROM t WHERE cls IN (SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part)""")
def rule_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and the classes that they name as whole tokens."""
    p = table(spark, sf_dir, "part")
    rules = p.select(F.col("p_partkey").alias("rule"), F.concat_ws(" ", "p_brand", "p_type").alias("body"))
    return R.rule_mentions(rules, p.select(F.explode(F.array("p_type", "p_brand")).alias("cls")))


@query("""WITH r AS (SELECT event_id AS iri, CASE WHEN event_id % 3 <> 0 THEN event_id // 3 END AS up FROM events)
SELECT a.iri AS iri, 1 + CAST(a.up IS NOT NULL AS INT) + CAST(b.up IS NOT NULL AS INT) + CAST(c.up IS NOT NULL AS INT) + CAST(d.up IS NOT NULL AS INT) AS depth
FROM r a LEFT JOIN r b ON a.up = b.iri LEFT JOIN r c ON b.up = c.iri LEFT JOIN r d ON c.up = d.iri""")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of sources, four steps up."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("iri"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("event_id") / 3)).alias("source_ref"))
    return R.provenance(e).select("iri", "depth")


@query("""WITH x AS (SELECT concat('cohort', user_id % 8) AS service, user_id, CAST(ts AS DATE) AS day, event_type, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id, event_type) AS p FROM events),
k AS (SELECT * FROM x WHERE p IS NULL OR p <> event_type), t AS (SELECT service, user_id, day FROM k GROUP BY ALL HAVING count(*) >= 4),
n AS (SELECT service, count(*) AS n FROM t GROUP BY 1), r AS (SELECT service, event_type AS symbol, count(DISTINCT (user_id, day)) / any_value(n) AS rate FROM k JOIN t USING (service, user_id, day) JOIN n USING (service) GROUP BY 1, 2)
SELECT service, symbol, round(rate, 6) AS rate, CASE WHEN rate >= 0.5 THEN 'mode' WHEN rate < 0.3 THEN 'novel' ELSE 'ordinary' END AS kind FROM r""")
def bag_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a service's trajectories hold each symbol."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("cohort"), F.col("user_id") % 8).alias("service"), "user_id", F.to_date("ts").alias("day"), "ts", "event_type", "event_id")
    return S.bag_novelty(S.trajectories(e, ["service", "user_id", "day"], "ts", "event_type", 4, "event_id"), "service")


@query("""WITH t AS (SELECT concat(event_type, '@', hour(ts)) AS template, ts < TIMESTAMP '2024-01-03' AS old FROM events),
n AS (SELECT template, count(*) AS hits FROM t WHERE NOT old AND template NOT IN (SELECT template FROM t WHERE old) GROUP BY 1)
SELECT template, hits, round(least(1, 0.3 + 0.05 * hits)::DOUBLE, 6) AS confidence FROM n WHERE hits >= 3""")
def new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that the catalogue of the first days lacks."""
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    t = table(spark, sf_dir, "events").select(F.concat_ws("@", "event_type", F.hour("ts")).alias("template"), (F.col("ts") < cut).alias("old"))
    fresh = t.filter("not old").groupBy("template").agg(F.count("*").alias("hits")).filter("hits >= 3")
    known = t.filter("old").select("template").distinct()
    return fresh.join(known, "template", "left_anti").withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 + 0.05 * F.col("hits")), 6))


@query("""SELECT concat('MERGE (a:Entity {id: ''', o_custkey, '''}) MERGE (b:Entity {id: ''', o_orderkey, '''}) MERGE (a)-[:HAS_ORDER]->(b);') AS statement FROM orders""")
def cypher_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as statements of a graph store."""
    e = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"), F.lit("has order").alias("label"))
    return sinks.cypher(e)


@query()
def graphql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as GraphQL types."""
    return sinks.graphql(columns(spark, sf_dir))


@query(f"""WITH {ENTITIES}, t AS (SELECT DISTINCT ent.v, ent.rid, ent.at FROM ent),
l AS (SELECT e.src, e.dst, round(count(*) FILTER (a.at < b.at) / nullif(count(*) FILTER (a.at <> b.at), 0), 6) AS lead
  FROM edges e JOIN (t a JOIN t b ON abs(a.at - b.at) <= 60 AND a.v < b.v) ON a.v = e.src AND b.v = e.dst GROUP BY ALL),
d AS (SELECT CASE WHEN lead <= 0.3 THEN dst ELSE src END AS src, CASE WHEN lead <= 0.3 THEN src ELSE dst END AS dst, CASE WHEN lead <= 0.3 THEN 1 - lead ELSE lead END AS lead FROM l WHERE lead <= 0.3 OR lead >= 0.7)
SELECT src, dst, printf('rule: %s_then_%s%swhen: %s followed_by %s within 60s%sconfidence: %.2f', src, dst, chr(10), src, dst, chr(10), lead) AS rule FROM d""")
def detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges of slot values as correlation rules."""
    return sinks.detection_rules(directed(entity_edges(spark, sf_dir)[1]))


@query("""SELECT concat('<http://example.org/nation/', n_nationkey, '> <http://example.org/name> "', n_name, '" .') AS value FROM nation""")
def n_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of N-Triples."""
    return sinks.n_triples(triples(spark, sf_dir).filter("p = 'name' and s like 'nation/%'"))


ONTOLOGY = """t AS (SELECT * FROM (
 SELECT DISTINCT 'b:' || p_brand AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM part
 UNION SELECT DISTINCT 'b:' || p_brand, 'rdfs:label', ' Brand ' || right(p_brand, 1) FROM part WHERE p_size > 3
 UNION SELECT DISTINCT 'y:' || p_size, 'rdf:type', CASE WHEN p_size % 2 = 0 THEN 'owl:ObjectProperty' ELSE 'owl:DatatypeProperty' END FROM part
 UNION SELECT DISTINCT 'y:' || p_size, 'rdfs:domain', 'b:' || p_brand FROM part WHERE p_size % 5 < 3
 UNION SELECT DISTINCT 'y:' || p_size, 'rdfs:range', CASE WHEN p_size % 3 = 0 THEN 'xsd:string' ELSE 'z:' || p_size END FROM part WHERE p_size % 7 > 0
 UNION SELECT DISTINCT 'z:' || p_size, 'rdf:type', 'rdfs:Datatype' FROM part WHERE p_size % 11 = 0
 UNION SELECT DISTINCT 'b:' || p_brand, 'rdfs:subClassOf', 'b:' || CASE WHEN p_size = 7 THEN p_brand ELSE 'top' END FROM part WHERE p_size < 9
 UNION SELECT 'onto:' || r_name, 'rdf:type', 'owl:Ontology' FROM region UNION SELECT 'onto:' || r_name, 'dcterms:rights', 'free' FROM region WHERE r_regionkey > 2))"""


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of an ontology made of the parts: brands are classes, sizes properties."""
    part, region = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    brand, size = F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("y:"), F.col("p_size"))
    z, n, onto = F.concat(F.lit("z:"), F.col("p_size")), F.col("p_size"), F.concat(F.lit("onto:"), "r_name")
    t = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    parts = [
        t(part, brand, "rdf:type", F.lit("owl:Class")),
        t(part.filter(n > 3), brand, "rdfs:label", F.concat(F.lit(" Brand "), F.right(F.col("p_brand"), F.lit(1)))),
        t(part, size, "rdf:type", F.when(n % 2 == 0, "owl:ObjectProperty").otherwise("owl:DatatypeProperty")),
        t(part.filter(n % 5 < 3), size, "rdfs:domain", brand),
        t(part.filter(n % 7 > 0), size, "rdfs:range", F.when(n % 3 == 0, F.lit("xsd:string")).otherwise(z)),
        t(part.filter(n % 11 == 0), z, "rdf:type", F.lit("rdfs:Datatype")),
        t(part.filter(n < 9), brand, "rdfs:subClassOf", F.concat(F.lit("b:"), F.when(n == 7, F.col("p_brand")).otherwise("top"))),
        t(region, onto, "rdf:type", F.lit("owl:Ontology")), t(region.filter("r_regionkey > 2"), onto, "dcterms:rights", F.lit("free")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


@query(f"""WITH {ONTOLOGY}, cls AS (SELECT s FROM t WHERE p = 'rdf:type' AND o = 'owl:Class'), prop AS (SELECT s FROM t WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')),
lab AS (SELECT DISTINCT s, lower(trim(o)) AS l FROM t JOIN cls USING (s) WHERE p = 'rdfs:label'),
sig AS (SELECT o AS c, list_sort(list(DISTINCT s)) AS g FROM t WHERE p = 'rdfs:domain' AND s IN (FROM prop) GROUP BY 1 HAVING count(DISTINCT s) >= 3)
SELECT 'P04' AS pitfall, s AS element FROM cls WHERE s NOT IN (SELECT o FROM t WHERE p IN ('rdfs:domain', 'rdfs:range') AND s IN (FROM prop)) AND s NOT IN (SELECT s FROM t WHERE p = 'rdfs:subClassOf' UNION SELECT o FROM t WHERE p = 'rdfs:subClassOf')
UNION ALL SELECT DISTINCT 'P07', s FROM lab WHERE l IN (SELECT l FROM lab GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'P08', s FROM (SELECT s FROM cls UNION SELECT s FROM prop) WHERE s NOT IN (SELECT s FROM t WHERE p = 'rdfs:label')
UNION ALL SELECT 'P11', s FROM prop WHERE s NOT IN (SELECT s FROM t WHERE p = 'rdfs:domain') OR s NOT IN (SELECT s FROM t WHERE p = 'rdfs:range')
UNION ALL SELECT 'P13', s FROM t WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty' AND NOT EXISTS (SELECT 1 FROM t WHERE p = 'owl:inverseOf')
UNION ALL SELECT 'P19', s FROM t WHERE p = 'rdfs:domain' GROUP BY s HAVING count(DISTINCT o) > 1
UNION ALL SELECT DISTINCT 'P24', s FROM t WHERE p = 'rdfs:subClassOf' AND s = o
UNION ALL SELECT 'P30', c FROM sig WHERE g IN (SELECT g FROM sig GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT DISTINCT 'P35', o FROM t WHERE p IN ('rdfs:domain', 'rdfs:range') AND NOT starts_with(o, 'xsd:') AND o NOT IN (SELECT s FROM t WHERE p = 'rdf:type' AND o IN ('owl:Class', 'rdfs:Datatype'))
UNION ALL SELECT 'P41', s FROM t WHERE p = 'rdf:type' AND o = 'owl:Ontology' AND s NOT IN (SELECT s FROM t WHERE p IN ('dcterms:license', 'dcterms:rights'))""")
def quality_pitfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling pitfalls of an ontology made of the parts."""
    return graph.pitfalls(ontology(spark, sf_dir))


@query("""WITH e AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT (SELECT count(DISTINCT b) FROM e WHERE b NOT IN (SELECT a FROM e)) AS roots, (SELECT count(DISTINCT a) FROM e WHERE a NOT IN (SELECT b FROM e)) AS leaves, (SELECT count(*) FROM e) AS edges""")
def structural_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, leaves and edges of the hierarchy."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    e = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b")).unionByName(
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("a"), F.col("n_name").alias("b"))).distinct()
    a, b = e.select(F.col("a").alias("x")).distinct(), e.select(F.col("b").alias("x")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(b.join(a, "x", "left_anti"), "roots").crossJoin(count(a.join(b, "x", "left_anti"), "leaves")).crossJoin(count(e, "edges"))


@query("""WITH c AS (SELECT 'events with a value' AS criterion, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END) AS share FROM events
UNION ALL SELECT 'documents with labels', (SELECT count(*) FROM labels) / count(*) FROM documents UNION ALL SELECT 'customers with orders', (SELECT count(DISTINCT o_custkey) FROM orders) / count(*) FROM customer)
SELECT criterion, round(share, 6) AS share, CAST(CASE WHEN share >= 0.9 THEN 5 WHEN share >= 0.75 THEN 4 WHEN share >= 0.5 THEN 3 WHEN share >= 0.25 THEN 2 WHEN share > 1e-9 THEN 1 ELSE 0 END AS INT) AS score FROM c""")
def governance_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banded ratios, one aggregate for each criterion."""
    t = lambda n: table(spark, sf_dir, n)
    a = t("events").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("share")).select(F.lit("events with a value").alias("criterion"), "share")
    ratio = lambda name, part, whole: part.agg(F.count("*").alias("k")).crossJoin(whole.agg(F.count("*").alias("n"))).select(
        F.lit(name).alias("criterion"), (F.col("k") / F.col("n")).alias("share"))
    x = a.unionByName(ratio("documents with labels", t("labels"), t("documents"))).unionByName(
        ratio("customers with orders", t("orders").select("o_custkey").distinct(), t("customer")))
    return x.select("criterion", F.round("share", 6).alias("share"), R.banded(F.col("share")).alias("score"))


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%part%' OR lower(p_type) LIKE '%red%' OR lower(p_type) LIKE '%part%' ORDER BY p_partkey DESC LIMIT 20""")
def keyword_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold a word of a question: a top-k report, newest first."""
    return G.grounded(table(spark, sf_dir, "part"), ["p_name", "p_type"], "a red part of", 20, "p_partkey").select("p_partkey", "p_name")


@query()
def gp_rate_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts against a Gaussian process of their type."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "cluster")
    return models.gp_rates(hourly_counts(e, "cluster", "ts"), "cluster")


@query()
def template_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of the parts' type and name templates by PCA of their words."""
    t = table(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("template")).distinct()
    return models.nearest_templates(models.template_vectors(t))


@query()
def review_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of approval of each labelled document, by a balanced logistic model."""
    from pyspark.ml.functions import vector_to_array

    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("approved"), F.col("n_chars").cast("double").alias("chars"),
        F.regexp_count("text", F.lit(r"[^\w\s]")).cast("double").alias("marks"))
    model = models.review_ranker(d, ["chars", "marks"], "lang")
    if model is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("chance"))
    scored = model.transform(d.withColumn("_w", F.lit(1.0)).withColumn("_y", F.col("approved").cast("double")))
    return scored.select("doc_id", vector_to_array("probability")[1].alias("chance"))
