"""Competency-question shapes over the star schema: joins, filters, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.catalogue import query
from weftline.session import table


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey IN (0, 1)")
def cq_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with a further predicate in its condition."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    on = (c["c_nationkey"] == n["n_nationkey"]) & n["n_regionkey"].isin(0, 1)
    return c.join(n, on, "left").select("c_custkey", "c_name", "n_name")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def cq_inner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inner joins to dimensions."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.filter("s_acctbal > 0").join(n, s["s_nationkey"] == n["n_nationkey"]).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    ).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT r_name, n_name, o_orderpriority, count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE p_size < 25 AND s_acctbal > 0 GROUP BY 1, 2, 3""")
def cq_eight_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven joins along the schema, then aggregates."""
    t = lambda n: table(spark, sf_dir, n)
    x = (
        t("lineitem").join(t("part").filter("p_size < 25").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").filter("s_acctbal > 0").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return x.groupBy("r_name", "n_name", "o_orderpriority").agg(
        F.countDistinct("o_orderkey").alias("orders"),
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"),
    )


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
WHERE a.n_name <> 'NATION_1' OR b.n_name IS NULL""")
def cq_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self join with an inequality, left."""
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    x = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")), "left")
    return x.filter("a.n_name <> 'NATION_1' or b.n_name is null").select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT n_name, count(*) AS parties FROM nation JOIN (SELECT DISTINCT n_nationkey AS nk, kind, k FROM nation JOIN
 (SELECT 'c' AS kind, c_custkey AS k, c_nationkey AS x FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey FROM supplier) ON n_nationkey = x) ON n_nationkey = nk GROUP BY 1""")
def cq_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on either of two parties, as one equality over both."""
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s"), "s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation")
    return c.union(s).join(n, F.col("x") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("parties"))


@query("SELECT p_brand, r_name, count(*) AS n FROM part CROSS JOIN region WHERE p_size = 10 GROUP BY 1, 2")
def cq_uncorrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncorrelated join: the filtered parts against the five regions."""
    p, r = table(spark, sf_dir, "part").filter("p_size = 10"), table(spark, sf_dir, "region")
    return p.crossJoin(F.broadcast(r)).groupBy("p_brand", "r_name").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END AS sev
FROM orders WHERE o_orderstatus NOT IN ('F') ORDER BY sev, o_totalprice DESC, o_orderkey LIMIT 50""")
def cq_case_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN and a sort by severity: a top-k report."""
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(
        F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(9)
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("F")).withColumn("sev", sev).orderBy(
        "sev", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "sev")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a large order."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders."""
    o = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer, by one combined aggregate."""
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m")
    )
    return x.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k <= 2""")
def fk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two neighbours of each row along a foreign key."""
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    x = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).filter("k <= 2")
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH a AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 20), b AS (SELECT DISTINCT p_brand FROM part WHERE p_size >= 20)
SELECT p_brand, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT p_brand, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT p_brand, 'kept' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and kept members of two versions, by one full outer join."""
    p = table(spark, sf_dir, "part")
    a = p.filter("p_size < 20").select("p_brand").distinct().withColumn("a", F.lit(True))
    b = p.filter("p_size >= 20").select("p_brand").distinct().withColumn("b", F.lit(True))
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("kept")
    return a.join(b, "p_brand", "full").select("p_brand", change.alias("change"))


@query("""WITH a AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE lang IN ('en', 'fr')), b AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000 ELSE 0 END AS id, md5(lower(text)) AS h FROM documents WHERE lang IN ('en', 'de'))
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS status FROM a FULL JOIN b ON a.id = b.id
WHERE a.h IS DISTINCT FROM b.h""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles added, removed or changed by hash between two versions of a feed."""
    d = table(spark, sf_dir, "documents")
    a = d.filter("lang in ('en', 'fr')").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    b = d.filter("lang in ('en', 'de')").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1000000).otherwise(0)).alias("id"), F.md5(F.lower("text")).alias("g"))
    x = a.join(b, "id", "full").filter(~F.col("h").eqNullSafe(F.col("g")))
    return x.select("id", F.when(F.col("h").isNull(), "ADDED").when(F.col("g").isNull(), "REMOVED").otherwise("CHANGED").alias("status"))


@query("""SELECT CASE WHEN grouping(r_name) = 1 THEN 'ALL' ELSE r_name END AS r, CASE WHEN grouping(c_mktsegment) = 1 THEN 'ALL' ELSE c_mktsegment END AS s, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on all combinations of two dimensions."""
    x = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda c: F.when(F.grouping(c) == 1, "ALL").otherwise(F.col(c))
    g = x.cube("r_name", "c_mktsegment").agg(name("r_name").alias("r"), name("c_mktsegment").alias("s"), F.count("*").alias("n"))
    return g.select("r", "s", "n")


@query("SELECT o_orderstatus, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1 HAVING count(*) >= 10")
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with enough evidence and their distinct labels in order."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("o_orderpriority"))).alias("priorities")
    ).filter("n >= 10")


@query("""SELECT a.event_type AS a, b.event_type AS b, count(*) AS users FROM (SELECT DISTINCT user_id, event_type FROM events) a
JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""")
def class_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity types that one entity has together."""
    from weftline.operators.mining import trace_pairs

    x = trace_pairs(table(spark, sf_dir, "events"), "user_id", "event_type")
    return x.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("cooc").alias("users"))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, role FROM t WHERE p IS NULL OR p <> role""")
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role differs from the turn before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumn("p", F.lag("role").over(w))
    return x.filter("p is null or p <> role").select("conv_id", "turn", "role")


@query("""WITH s AS (SELECT user_id, round(avg(value), 6) AS v FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v, user_id) AS k, count(*) OVER () AS n FROM s)
SELECT user_id, v FROM r WHERE k <= greatest(1, CAST(floor(n * 0.05) AS BIGINT))""")
def bottom_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest twentieth of the entities by mean, one at least; the cut comes from a count and a limit sort."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    return s.orderBy("v", "user_id").limit(max(1, int(s.count() * 0.05)))
