"""Queries on records as graphs: provenance, sensitivity, shape, subgraphs, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.operators import graph as G
from weftline.operators import lineage as L
from weftline.operators import records as R
from weftline.operators.vectors import TIERS
from weftline.plans.catalog import ONTOLOGY, ontology
from weftline.session import table

TIER_OF = "(['Public', 'Internal', 'Confidential', 'Restricted'])[{} % 4 + 1]"
P = R.Property


def _tier(column: str):
    return F.element_at(F.array(*map(F.lit, TIERS)), (F.col(column) % 4 + 1).cast("int"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observation rows of a relational source."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "event_type", F.concat(F.lit("a-"), F.col("user_id") % 50).alias("recorded_by"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("observed_at"),
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("valid_from"),
        F.when(F.col("event_id") % 5 == 0, F.lit("2025-01-01")).alias("valid_to"),
        F.when(F.col("event_id") % 2 == 0, "ms").alias("unit"), (F.col("event_id") % 7).cast("string").alias("amount"),
        F.when(F.col("event_id") % 4 == 0, F.col("user_id") % 9).alias("incident_id"), F.when(F.col("event_id") % 8 == 0, "lead").alias("role"),
        F.lit("x").alias("secret"))


OBSERVED = {
    "event_type": P("kind", "Public"), "recorded_by": P("recordedBy", "Internal", "Agent"), "observed_at": P("observedAt", "Public"),
    "valid_from": P("from", "Public"), "valid_to": P("to", "Public"), "unit": P("unit", "Public"), "amount": P("amount", "Public"),
    "incident_id": P("incident", "Public", "Incident"), "role": P("role", "Public"), "secret": P("secret", "Restricted"),
}


@query("""WITH e AS (SELECT event_id AS i, 'Observation/' || event_id AS s, event_type, 'Agent/A' || user_id % 50 AS a, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%Y-%m-%d') AS d,
 'ObservationDerivation/' || event_id AS act, 'ObservationValidity/' || event_id AS v, 'ObservationQuantity/' || event_id AS q, user_id % 9 AS inc FROM events)
SELECT s, 'rdf:type' AS p, 'Observation' AS o, 'Public' AS tier FROM e UNION ALL SELECT s, 'kind', event_type, 'Public' FROM e UNION ALL SELECT s, 'recordedBy', a, 'Internal' FROM e
UNION ALL SELECT s, 'observedAt', t, 'Public' FROM e UNION ALL SELECT s, 'from', d, 'Public' FROM e WHERE i % 3 = 0 UNION ALL SELECT s, 'to', '2025-01-01', 'Public' FROM e WHERE i % 5 = 0
UNION ALL SELECT s, 'unit', 'ms', 'Public' FROM e WHERE i % 2 = 0 UNION ALL SELECT s, 'amount', CAST(i % 7 AS VARCHAR), 'Public' FROM e UNION ALL SELECT s, 'incident', 'Incident/' || inc, 'Public' FROM e WHERE i % 4 = 0
UNION ALL SELECT s, 'role', 'lead', 'Public' FROM e WHERE i % 8 = 0
UNION ALL SELECT s, 'rdf:type', 'prov:Entity', 'Internal' FROM e UNION ALL SELECT s, 'prov:wasGeneratedBy', act, 'Internal' FROM e UNION ALL SELECT s, 'prov:wasAttributedTo', a, 'Internal' FROM e
UNION ALL SELECT act, 'rdf:type', 'DerivationActivity', 'Internal' FROM e UNION ALL SELECT act, 'prov:wasAssociatedWith', a, 'Internal' FROM e UNION ALL SELECT act, 'prov:generated', s, 'Internal' FROM e
UNION ALL SELECT s, 'prov:generatedAtTime', t, 'Internal' FROM e UNION ALL SELECT act, 'prov:startedAtTime', t, 'Internal' FROM e
UNION ALL SELECT s, 'hasValidityPeriod', v, 'Public' FROM e WHERE i % 3 = 0 OR i % 5 = 0 UNION ALL SELECT v, 'rdf:type', 'TemporalExtent', 'Public' FROM e WHERE i % 3 = 0 OR i % 5 = 0
UNION ALL SELECT v, 'validFrom', d, 'Public' FROM e WHERE i % 3 = 0 UNION ALL SELECT v, 'validUntil', '2025-01-01', 'Public' FROM e WHERE i % 5 = 0
UNION ALL SELECT s, 'hasQuantity', q, 'Public' FROM e WHERE i % 2 = 0 UNION ALL SELECT q, 'rdf:type', 'QuantityValue', 'Public' FROM e WHERE i % 2 = 0
UNION ALL SELECT q, 'numericValue', (i % 7) || '.0', 'Public' FROM e WHERE i % 2 = 0 UNION ALL SELECT q, 'unitOfMeasure', 'ms', 'Public' FROM e WHERE i % 2 = 0
UNION ALL SELECT s, 'rdf:type', 'Participation', 'Internal' FROM e WHERE i % 4 = 0 UNION ALL SELECT s, 'participationIn', 'Incident/' || inc, 'Internal' FROM e WHERE i % 4 = 0
UNION ALL SELECT s, 'participatingAgent', a, 'Internal' FROM e WHERE i % 4 = 0 UNION ALL SELECT s, 'participationRole', 'lead', 'Internal' FROM e WHERE i % 8 = 0""")
def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation rows as linked individuals with provenance, validity, quantities and roles, within a ceiling."""
    return R.individuals(observed(spark, sf_dir), "Observation", "event_id", OBSERVED, "Confidential", ("Incident",)).drop("o_is_iri")


@query(f"""WITH a AS (SELECT 's' || s_suppkey AS x, 'n' || s_nationkey AS y, s_suppkey % 4 AS r FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 4 FROM nation),
w AS (SELECT x, y, r FROM a UNION ALL SELECT a.x, b.y, greatest(a.r, b.r) FROM a JOIN a b ON a.y = b.x)
SELECT x, y, {TIER_OF.format('max(r)')} AS tier FROM w GROUP BY 1, 2""")
def derived_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the places that suppliers and nations lie in, by all premises of each fact."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda a, b, x, y, k: (F.concat(F.lit(a), F.col(x)).alias("a1"), F.concat(F.lit(b), F.col(y)).alias("a2"), _tier(k).alias("tier"))
    e = s.select(*name("s", "n", "s_suppkey", "s_nationkey", "s_suppkey")).unionByName(n.select(*name("n", "r", "n_nationkey", "n_regionkey", "n_nationkey")))
    rules = [("base", ("within", ("?x", "?y")), [("in", ("?x", "?y"))]), ("step", ("within", ("?x", "?z")), [("in", ("?x", "?y")), ("within", ("?y", "?z"))])]
    facts = G.datalog({"in": e.select("a1", "a2")}, rules)
    asserted = e.select(F.lit("in").alias("predicate"), F.array("a1", "a2").alias("args"), "tier")
    got = L.sensitivity(asserted, L.derivations(facts, rules)).filter("predicate = 'within'")
    return got.select(F.col("args")[0].alias("x"), F.col("args")[1].alias("y"), "tier")


@query(f"""WITH t AS (SELECT 'n' || n_nationkey AS c, n_nationkey % 4 AS r FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey % 4 FROM region UNION ALL SELECT 's' || s_suppkey, s_suppkey % 4 FROM supplier),
e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT child, parent, {TIER_OF.format('a.r')} AS child_tier, {TIER_OF.format('b.r')} AS parent_tier FROM e JOIN t a ON a.c = child JOIN t b ON b.c = parent WHERE a.r < b.r""")
def sensitivity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred subclass edges whose child is less sensitive than its parent."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    edge = lambda df, a, b: df.select(a.alias("a"), b.alias("b"))
    edges = edge(s, name("s", "s_suppkey"), name("n", "s_nationkey")).unionByName(edge(n, name("n", "n_nationkey"), name("r", "n_regionkey")))
    closed = G.closure(edges).select(F.col("a").alias("s"), F.lit(G.SUB).alias("p"), F.col("b").alias("o"))
    of = lambda df, k, c: df.select(name(k, c).alias("cls"), _tier(c).alias("tier"))
    return L.weaker_children(closed, of(s, "s", "s_suppkey").unionByName(of(n, "n", "n_nationkey")).unionByName(of(r, "r", "r_regionkey")))


HIERARCHY = f"""{ONTOLOGY}, h AS (SELECT 'c:' || n_name AS s, 'rdfs:subClassOf' AS p, 'c:' || r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c:' || s_suppkey, 'rdfs:subClassOf', 'c:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'c:' || n_name, 'rdf:type', 'owl:Class' FROM nation UNION ALL SELECT 'c:' || r_name, 'rdf:type', 'owl:Class' FROM region UNION ALL SELECT 'c:' || s_suppkey, 'rdf:type', 'owl:Class' FROM supplier
 UNION ALL SELECT 'k:' || r_name, 'rdfs:subClassOf', 'k:' || r_name || 'x' FROM region UNION ALL SELECT 'k:' || r_name || 'x', 'rdfs:subClassOf', 'k:' || r_name FROM region),
g AS (SELECT s, p, o FROM t UNION SELECT s, p, o FROM h)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' ontology, suppliers below nations below regions, and some cycles."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    c = lambda x, k="c:", end="": F.concat(F.lit(k), F.col(x), F.lit(end))
    t = lambda df, a, p, o: df.select(a.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    nr, sn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    out = ontology(spark, sf_dir)
    for part in (
        t(nr, c("n_name"), G.SUB, c("r_name")), t(sn, c("s_suppkey"), G.SUB, c("n_name")),
        *[t(df, c(x), G.TYPE, F.lit("owl:Class")) for df, x in ((n, "n_name"), (r, "r_name"), (s, "s_suppkey"))],
        t(r, c("r_name", "k:"), G.SUB, c("r_name", "k:", "x")), t(r, c("r_name", "k:", "x"), G.SUB, c("r_name", "k:")),
    ):
        out = out.unionByName(part)
    return out.distinct()


@query(f"""WITH RECURSIVE {HIERARCHY}, e AS (SELECT DISTINCT s AS child, o AS parent FROM g WHERE p = 'rdfs:subClassOf' AND s <> o), cls AS (SELECT DISTINCT s FROM g WHERE p = 'rdf:type' AND o = 'owl:Class'),
ob AS (SELECT DISTINCT s FROM g WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty'), da AS (SELECT DISTINCT s FROM g WHERE p = 'rdf:type' AND o = 'owl:DatatypeProperty'),
d AS (SELECT parent AS node, 1 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child, depth + 1 FROM d JOIN e ON e.parent = d.node),
x AS (SELECT (SELECT count(*) FROM cls) AS c, (SELECT count(*) FROM e) AS k, (SELECT count(*) FROM ob) AS o, (SELECT count(*) FROM da) AS a)
SELECT c AS classes, (SELECT count(*) FROM (FROM ob UNION FROM da)) AS properties, a AS data_properties, o AS object_properties, (SELECT count(*) FROM cls WHERE s NOT IN (SELECT child FROM e)) AS roots,
 (SELECT count(*) FROM cls WHERE s NOT IN (SELECT parent FROM e)) AS leaves, (SELECT count(*) FROM (SELECT child FROM e UNION SELECT parent FROM e) WHERE child NOT IN (SELECT node FROM d)) AS cyclic, 0::BIGINT AS restrictions, 0::BIGINT AS defined_classes,
 (SELECT max(depth) FROM d) AS max_depth, round(k / greatest(c, 1), 2) AS inheritance_richness, round(a / greatest(c, 1), 2) AS attribute_richness, round(o / greatest(o + k, 1), 2) AS relationship_richness FROM x""")
def hierarchy_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, breadth and richness of an ontology."""
    return L.shape(hierarchy(spark, sf_dir))


@query(f"""WITH {HIERARCHY}, y AS (SELECT s, p, o FROM g UNION ALL SELECT 'y:' || p_size, 'owl:inverseOf', 'y:' || (p_size + 1) FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'b:' || p_brand, 'owl:disjointWith', 'b:top' FROM part WHERE p_size = 3),
k AS (SELECT CASE p WHEN 'owl:inverseOf' THEN 'owl:inverseOf' WHEN 'owl:disjointWith' THEN 'class disjointness' END AS construct, count(*) AS n FROM y GROUP BY 1)
SELECT CASE WHEN count(construct) > 0 THEN 'OWL 2 DL' ELSE 'OWL 2 EL' END AS profile, CAST(sum(n) AS BIGINT) AS axioms, coalesce(string_agg(construct || ':' || n, ', ' ORDER BY construct) FILTER (construct IS NOT NULL), '') AS constructs,
 CASE WHEN count(construct) > 0 THEN 'HermiT' ELSE 'ELK' END AS reasoner FROM k""")
def ontology_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that the parts' ontology with inverses and disjoint classes asks for."""
    part = table(spark, sf_dir, "part")
    t = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    y = lambda n: F.concat(F.lit("y:"), n)
    more = t(part.filter("p_size % 10 = 0"), y(F.col("p_size")), "owl:inverseOf", y(F.col("p_size") + 1))
    apart = t(part.filter("p_size = 3"), F.concat(F.lit("b:"), "p_brand"), "owl:disjointWith", F.lit("b:top"))
    return L.owl_profile(hierarchy(spark, sf_dir).unionByName(more).unionByName(apart))


CUSTOMER = {"c_custkey": P("key", "Public"), "c_name": P("name", "Internal"), "c_mktsegment": P("segment", "Public"), "c_acctbal": P("balance", "Restricted")}
ORDER = {"o_orderkey": P("order", "Public"), "o_orderstatus": P("status", "Public"), "o_totalprice": P("total", "Restricted"), "o_orderpriority": P("priority", "Internal")}


def _near(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "lineitem", "part")}
    keys = [R.Key("o_custkey", "customer", "c_custkey", CUSTOMER), R.Key("o_orderkey", "lineitem", "l_orderkey", {"l_linenumber": P("line", "Public"), "l_returnflag": P("mode", "Public")}),
            R.Key("o_orderkey", "part", "p_partkey", {"p_name": P("name", "Restricted")})]
    return R.neighbours(rows, "o_orderkey", keys, t, "Internal", {"customer", "lineitem", "part"}, ("c_name",), 5)[0]


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
l AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY '{"l_linenumber":"' || l_linenumber || '","l_returnflag":"' || l_returnflag || '"}') AS k FROM lineitem)
SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'o_custkey' AS col, 'customer' AS ref_table, CAST(c_custkey AS VARCHAR) AS ref_key, c_custkey || '|' || c_mktsegment || '|' || '•••' AS record FROM o JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderkey', 'lineitem', CAST(o_orderkey AS VARCHAR), l_linenumber || '|' || l_returnflag FROM o JOIN l ON l_orderkey = o_orderkey WHERE k <= 5""")
def key_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that urgent orders point at, five for a key, within a ceiling and with names masked."""
    near = _near(spark, sf_dir, _urgent(spark, sf_dir))
    values = F.array_join(F.map_values(F.map_from_entries(F.array_sort(F.map_entries("record")))), "|")
    return near.select("subject", F.col("column").alias("col"), "ref_table", "ref_key", values.alias("record"))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber AS VARCHAR), l_returnflag) AS k FROM lineitem) WHERE k <= 5),
x AS (SELECT 'Order/' || o_orderkey AS s, unnest(['rdf:type', 'order', 'status', 'priority']) AS p, unnest(['Order', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS o, unnest([0, 0, 0, 1]) AS r, 'row' AS via FROM o
UNION ALL SELECT 'Order/' || o_orderkey, 'o_custkey', 'customer/' || o_custkey, 1, 'key' FROM o JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'Order/' || o_orderkey, 'o_orderkey', 'lineitem/' || o_orderkey, 1, 'key' FROM o JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT 'customer/' || c_custkey, unnest(['rdf:type', 'c_custkey', 'c_name', 'c_mktsegment']), unnest(['customer', CAST(c_custkey AS VARCHAR), '•••', c_mktsegment]), 1, unnest(['key', 'neighbour', 'neighbour', 'neighbour']) FROM o JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'lineitem/' || o_orderkey, unnest(['rdf:type', 'l_linenumber', 'l_returnflag']), unnest(['lineitem', CAST(l_linenumber AS VARCHAR), l_returnflag]), 1, unnest(['key', 'neighbour', 'neighbour']) FROM o JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT 'Order/' || o_orderkey, 'rdf:type', 'Open', 1, 'derived' FROM o WHERE o_orderstatus = 'O')
SELECT s, p, o, (['Public', 'Internal'])[max(r) + 1] AS tier, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM x GROUP BY 1, 2, 3""")
def result_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders with their neighbours and derived facts as one table of triples."""
    rows = _urgent(spark, sf_dir)
    derived = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(
        F.lit("Open").alias("predicate"), F.array(F.col("o_orderkey").cast("string")).alias("args"), F.lit("Internal").alias("tier"))
    derived = derived.unionByName(table(spark, sf_dir, "orders").select(
        F.lit("Secret").alias("predicate"), F.array(F.col("o_orderkey").cast("string")).alias("args"), F.lit("Restricted").alias("tier")))
    return R.result_subgraph(rows, "o_orderkey", "Order", ORDER, "Internal", _near(spark, sf_dir, rows), derived, "Internal").drop("o_is_iri")


@query("""WITH h AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'Customer/' || (vec_id + 1) WHEN 1 THEN 'Order/' || vec_id ELSE 'Other/' || vec_id END AS iri FROM embeddings)
SELECT vec_id, iri, c_custkey IS NOT NULL OR o_orderkey IS NOT NULL AS found, CASE WHEN c_custkey IS NOT NULL THEN '{"@id":"' || iri || '","key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}'
 WHEN o_orderkey IS NOT NULL THEN '{"@id":"' || iri || '","order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' ELSE '{"@id":"' || iri || '"}' END AS record
FROM h LEFT JOIN customer ON iri = 'Customer/' || c_custkey LEFT JOIN orders ON iri = 'Order/' || o_orderkey""")
def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the whole record that their IRI names, read once for each table."""
    i = F.col("vec_id")
    iri = F.when(i % 3 == 0, F.concat(F.lit("Customer/"), i + 1)).when(i % 3 == 1, F.concat(F.lit("Order/"), i)).otherwise(F.concat(F.lit("Other/"), i))
    hits = table(spark, sf_dir, "embeddings").select("vec_id", iri.alias("iri"))
    return R.enriched(hits, {"Customer": (table(spark, sf_dir, "customer"), "c_custkey", CUSTOMER), "Order": (table(spark, sf_dir, "orders"), "o_orderkey", ORDER)}, "Public")


@query("""WITH RECURSIVE e AS (SELECT 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS o FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation),
far AS (SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s), every AS (SELECT * FROM e UNION SELECT * FROM far),
rich AS (SELECT 'supplier/' || s_suppkey AS s FROM supplier JOIN every ON s = 'supplier/' || s_suppkey JOIN region ON o = 'region/' || r_regionkey AND r_name = 'EUROPE' WHERE s_acctbal > 5000)
SELECT s, 'in' AS p, o, 'place_of_supplier' AS rule FROM far UNION ALL SELECT s, 'rdf:type', 'RichEuropean', 'rich_supplier' FROM rich
UNION ALL SELECT DISTINCT o, 'rdf:type', 'RichRegion', 'region_with_rich' FROM every JOIN rich USING (s) WHERE o LIKE 'region/%'""")
def folder_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the library's folder of SQL rules derives from the star schema's triples."""
    import os

    from weftline.operators import rule_folder
    from weftline.plans.graph import triples

    # the files come with the package, which every driver has
    folder = os.path.join(os.path.dirname(os.path.dirname(rule_folder.__file__)), "rules")
    rules = {}
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".sql")):
        with open(os.path.join(folder, name)) as f:
            rules[name.removesuffix(".sql")] = f.read()
    return rule_folder.run_rules(triples(spark, sf_dir), rules).select("s", "p", "o", "rule")
