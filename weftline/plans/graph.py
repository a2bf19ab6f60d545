"""Graph queries: the star schema as triples, its hierarchy as classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.operators import graph as G
from weftline.session import table


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions as triples."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    iri = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c))
    return reduce(DataFrame.unionByName, [
        G.to_triples(s, iri("supplier", "s_suppkey"), "Supplier", {"s_name": "name", "s_acctbal": "balance"}, {"in": iri("nation", "s_nationkey")}),
        G.to_triples(n, iri("nation", "n_nationkey"), "Nation", {"n_name": "name"}, {"in": iri("region", "n_regionkey")}),
        G.to_triples(r, iri("region", "r_regionkey"), "Region", {"r_name": "name"}),
    ])


T = """t AS (SELECT concat('supplier/', s_suppkey) AS s, unnest(['rdf:type', 'name', 'in']) AS p, unnest(['Supplier', s_name, concat('nation/', s_nationkey)]) AS o FROM supplier
UNION ALL SELECT concat('nation/', n_nationkey), unnest(['rdf:type', 'name', 'in']), unnest(['Nation', n_name, concat('region/', n_regionkey)]) FROM nation
UNION ALL SELECT concat('region/', r_regionkey), unnest(['rdf:type', 'name']), unnest(['Region', r_name]) FROM region)"""


@query(f"WITH {T} SELECT s, p, o FROM t")
def materialised_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as triples (without the balances, whose text differs between engines)."""
    return triples(spark, sf_dir).filter("p <> 'balance'").select("s", "p", "o")


@query("""SELECT concat('supplier/', s_suppkey) AS x, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basic graph pattern of six triples."""
    return G.match(triples(spark, sf_dir), [
        ("?x", "rdf:type", "Supplier"), ("?x", "in", "?n"), ("?n", "name", "?nation"), ("?n", "in", "?r"), ("?r", "name", "?region"),
        ("?r", "rdf:type", "Region"),
    ]).select("x", "nation", "region")


@query("""SELECT concat('nation/', n_nationkey) AS n, s AS x FROM nation LEFT JOIN (SELECT s_nationkey, concat('supplier/', s_suppkey) AS s FROM supplier) ON s_nationkey = n_nationkey""")
def graph_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their suppliers, if any."""
    t = triples(spark, sf_dir)
    return G.optional(G.match(t, [("?n", "rdf:type", "Nation")]), G.match(t, [("?x", "in", "?n"), ("?x", "rdf:type", "Supplier")])).select("n", "x")


@query("""SELECT concat('nation/', n_nationkey) AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)""")
def graph_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a rich supplier."""
    t = triples(spark, sf_dir)
    rich = G.match(t, [("?x", "in", "?n"), ("?x", "balance", "?b")]).filter(F.col("b").cast("double") > 9000)
    return G.not_exists(G.match(t, [("?n", "rdf:type", "Nation")]), rich.select("n")).select("n")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT concat('supplier/', s_suppkey) AS a, concat('nation/', s_nationkey) AS b FROM supplier
UNION SELECT concat('nation/', n_nationkey), concat('region/', n_regionkey) FROM nation),
c AS (SELECT a, b, 1 AS depth FROM e UNION SELECT c.a, e.b, depth + 1 FROM c JOIN e ON c.b = e.a) SELECT a, b, min(depth) AS depth FROM c GROUP BY 1, 2""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places that each element lies in."""
    return G.closure(triples(spark, sf_dir).filter("p = 'in'").select(F.col("s").alias("a"), F.col("o").alias("b")))


@query("""SELECT concat('supplier/', s_suppkey) AS x, concat('region/', n_regionkey) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT concat('supplier/', s_suppkey), concat('nation/', s_nationkey) FROM supplier UNION SELECT concat('nation/', n_nationkey), concat('region/', n_regionkey) FROM nation""")
def datalog_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """within(x, z) from in(x, y) by two rules."""
    e = triples(spark, sf_dir).filter("p = 'in'").select(F.col("s").alias("a1"), F.col("o").alias("a2"))
    rules = [
        ("base", ("within", ("?x", "?y")), [("in", ("?x", "?y"))]),
        ("step", ("within", ("?x", "?z")), [("in", ("?x", "?y")), ("within", ("?y", "?z"))]),
    ]
    got = G.datalog({"in": e}, rules).filter("predicate = 'within'")
    return got.select(F.col("args")[0].alias("x"), F.col("args")[1].alias("y"))


@query()
def owl_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived triples of the hierarchy under transitivity, subclasses and domains."""
    schema = spark.createDataFrame([
        ("in", "rdf:type", "owl:TransitiveProperty", True), ("Supplier", "rdfs:subClassOf", "Party", True),
        ("Party", "rdfs:subClassOf", "Thing", True), ("in", "rdfs:range", "Place", True),
    ], "s string, p string, o string, o_is_iri boolean")
    return G.owl_closure(triples(spark, sf_dir).filter("o_is_iri").unionByName(schema))


@query("""SELECT concat('supplier/', s_suppkey) AS s, 'rdf:type' AS p, 'EuropeanSupplier' AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""")
def construct_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's constructed triples; bindings stay as lineage in the operator."""
    where = [("?x", "in", "?n"), ("?n", "in", "?r"), ("?r", "name", "EUROPE"), ("?x", "rdf:type", "Supplier")]
    return G.construct(triples(spark, sf_dir), where, ("?x", "rdf:type", "EuropeanSupplier")).select("s", "p", "o")


@query(f"""WITH {T}, k AS (SELECT s AS id, 'entity' AS kind FROM t UNION ALL SELECT o, CASE WHEN p = 'name' THEN 'literal' WHEN p = 'rdf:type' THEN 'type' ELSE 'entity' END FROM t)
SELECT id, min(kind) AS kind FROM k GROUP BY 1""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph view."""
    return G.nodes_edges(triples(spark, sf_dir).filter("p <> 'balance'"))[0]


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def sibling_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that share a parent, to which a class's drift spreads."""
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(k), "n_regionkey", F.col("n_nationkey").alias(f"{k}k")) for k in "ab")
    return a.join(b, "n_regionkey").filter("ak <> bk").select("a", "b")
