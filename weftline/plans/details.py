"""Queries on lines, terms, signatures, impulses, catalogues found from rows, retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.functions import text as T
from weftline.operators import mining as M
from weftline.operators import models, series
from weftline.operators import vectors as V
from weftline.operators.range_join import seconds
from weftline.plans.retrieval import records
from weftline.session import table
from weftline.sources import tables


def _plain_sql(column: str) -> str:
    out = f"trim({column})"
    for pattern in (*T.LINE_TIMES, T.LINE_LEVELS):
        out = f"regexp_replace({out}, '{pattern}', ''{', ' + chr(39) + 'g' + chr(39) if pattern is T.LINE_LEVELS else ''})"
    for pattern, name in T.LINE_PARTS:
        out = f"regexp_replace({out}, '{pattern}', '{name}', 'g')"
    return f"trim({out})"


LINE = """concat(CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.123Z ' WHEN 1 THEN strftime(ts, '%b %d %H:%M:%S') || ' ' WHEN 2 THEN '1704067200123 ' ELSE '' END,
 CASE event_id % 3 WHEN 0 THEN 'WARNING: ' WHEN 1 THEN 'node error ' ELSE '' END, event_type, ' user ', user_id, ' from 10.0.', user_id % 256, '.7 id 00c0ffee', event_id % 10, ' took ', event_id % 50, '.5')"""


@query(f"WITH x AS (SELECT event_id, {_plain_sql(LINE)} AS line FROM events) SELECT event_id, CASE WHEN length(line) > 10 THEN line END AS line FROM x")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines without times and levels, variable parts named."""
    i, lit = F.col("event_id"), F.lit
    line = F.concat(
        F.when(i % 4 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), lit(".123Z "))).when(i % 4 == 1, F.date_format("ts", "MMM dd HH:mm:ss ")).when(
            i % 4 == 2, "1704067200123 ").otherwise(""),
        F.when(i % 3 == 0, "WARNING: ").when(i % 3 == 1, "node error ").otherwise(""), F.col("event_type"), lit(" user "), F.col("user_id").cast("string"), lit(" from 10.0."),
        (F.col("user_id") % 256).cast("string"), lit(".7 id 00c0ffee"), (i % 10).cast("string"), lit(" took "), (i % 50).cast("string"), lit(".5"))
    return table(spark, sf_dir, "events").select("event_id", T.plain_line(line).alias("line"))


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents), k AS (SELECT lower(t) AS term, CASE WHEN regexp_full_match(t, '[A-Z][a-z]+') THEN 2 ELSE 1 END AS w FROM t WHERE regexp_full_match(t, '[A-Z][a-z]+|[a-z]{4,}')),
f AS (SELECT term, sum(w) AS f FROM k GROUP BY 1), n AS (SELECT greatest(sum(f), 1)::DOUBLE AS n FROM f)
SELECT term, CAST(f AS BIGINT) AS frequency, round(100 * f / n * (ln(n / (f + 1)) + 1), 4) AS score FROM f, n WHERE f >= 3 AND length(term) >= 4 AND term NOT IN (SELECT DISTINCT lower(r_name) FROM region)""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words and plain ones of the documents, scored as candidates for classes."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("term"))
    named = w.filter(F.col("term").rlike("^[A-Z][a-z]+$")).withColumn("term", F.lower("term"))
    return M.entity_scores(named, w.filter(F.col("term").rlike("^[a-z]{4,}$")), table(spark, sf_dir, "region").select(F.lower("r_name").alias("term")))


@query(r"""WITH x AS (SELECT event_type || ' <*> at <*> ' || event_type AS template, ['IRI', CASE WHEN value < 20 THEN 'num' ELSE 'hex' END] AS types FROM events),
h AS (SELECT template, types, substr(sha256('tokens:' || array_to_string(list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(template, '<\*>', ' ', 'g')), '[a-z_]{2,}'))), ',')), 1, 16) AS a,
 substr(sha256('slots:' || upper(array_to_string(types, ','))), 1, 16) AS b FROM x)
SELECT template, array_to_string(types, ',') AS types, substr(sha256(a || '|' || b), 1, 16) AS signature, a AS tokens_hash, b AS slots_hash, count(*) AS n FROM h GROUP BY ALL""")
def typed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of templates with their slots' types."""
    e = table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(" <*> at <*> "), "event_type").alias("template"), F.array(F.lit("IRI"), F.when(F.col("value") < 20, "num").otherwise("hex")).alias("types"))
    sig, a, b = T.template_signature(F.col("template"), F.col("types"))
    x = e.select("template", F.array_join("types", ",").alias("types"), sig.alias("signature"), a.alias("tokens_hash"), b.alias("slots_hash"))
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderpriority AS kind, epoch(o_orderdate) AS t FROM orders), s AS (SELECT min(t) AS t0, CAST(floor((max(t) - min(t)) / 86400) + 1 AS BIGINT) AS bins FROM o),
d AS (SELECT kind, CAST(floor((t - t0) / 86400) AS BIGINT) AS b, any_value(bins) AS bins, count(*) AS k FROM o, s GROUP BY 1, 2), x AS (SELECT kind, b, k, unnest(range(b, least(bins, b + 27))) AS bin FROM d)
SELECT kind, bin, round(sum(k * pow(exp(-ln(2) / 2), bin - b)), 4) AS n FROM x GROUP BY 1, 2""")
def deploy_impulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as impulses that halve every two days, until they are below 1e-4."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), seconds("o_orderdate").alias("at"))
    return series.impulses(o, "kind", "at", 86400.0, 2 * 86400.0).withColumn("n", F.round("n", 4))


NAMES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
UNIQUE = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in NAMES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the catalogue."""
    return tables.row_counts({n: table(spark, sf_dir, n) for n in NAMES})


_PAIRS = (("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("nation", "n_regionkey", "region"), ("orders", "o_custkey", "customer"),
          ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"))


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{r}' AS target, '{UNIQUE[r]}' AS key, count(DISTINCT {c}) AS n FROM {t} HAVING count(DISTINCT {c}) >= 2 AND count(*) FILTER ({c} NOT IN (SELECT {UNIQUE[r]} FROM {r})) = 0"
    for t, c, r in _PAIRS))
def found_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys found from the rows: columns all of whose values another table's key has."""
    return tables.found_keys({n: table(spark, sf_dir, n) for n in NAMES}, UNIQUE)


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, concat('class', label) AS expected FROM embeddings ORDER BY vec_id LIMIT 20), r AS (SELECT vec_id, embedding::DOUBLE[] AS e, concat('class', label) AS cls FROM embeddings),
x AS (SELECT qid, expected, vec_id, cls, round(list_dot_product(q, e) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS sim FROM q, r WHERE vec_id <> qid),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM x QUALIFY rank <= 5), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM x WHERE cls = expected QUALIFY rank <= 5),
s AS (SELECT 'plain' AS strategy, * FROM p UNION ALL SELECT 'bounded', * FROM b),
m AS (SELECT strategy, count(*) AS queries, round(avg(pr), 4) AS precision, round(avg(rr), 4) AS mrr FROM (SELECT strategy, qid, count(*) FILTER (cls = expected) / count(*) AS pr, coalesce(1.0 / min(rank) FILTER (cls = expected), 0) AS rr FROM s GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT q.qid, count(p.vec_id) AS n, count(p.vec_id) FILTER (p.cls <> p.expected) AS wrong, count(p.vec_id) FILTER (p.cls <> p.expected AND NOT EXISTS (SELECT 1 FROM b WHERE b.qid = p.qid AND b.vec_id = p.vec_id)) AS gone FROM q LEFT JOIN p ON p.qid = q.qid GROUP BY 1),
t AS (SELECT strategy, ms, row_number() OVER (PARTITION BY strategy ORDER BY ms, qid) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM (SELECT 'plain' AS strategy, qid, (qid * 37 % 101)::DOUBLE AS ms FROM q UNION ALL SELECT 'bounded', qid, (qid * 53 % 89)::DOUBLE FROM q)),
l AS (SELECT strategy, max(ms) FILTER (i = n // 2) AS p50_ms, max(ms) FILTER (i = greatest(0, CAST(floor(0.95 * n + 0.5) AS BIGINT) - 1)) AS p95_ms FROM t GROUP BY 1)
SELECT strategy, queries, precision, mrr, CASE strategy WHEN 'bounded' THEN (SELECT round(avg(CASE WHEN wrong > 0 THEN gone / wrong WHEN n > 0 THEN 1.0 ELSE 0.0 END), 4) FROM w) ELSE 0.0 END AS wrong_class_blocked, p50_ms, p95_ms FROM m JOIN l USING (strategy)""")
def retrieval_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's twenty probes (a fixed set) with and without the bound on classes; times are given with the probes."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(20).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.concat(F.lit("class"), "label").alias("qlabel"))
    rec = e.withColumn("label", F.concat(F.lit("class"), "label"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))
    hits = lambda x: x.withColumn("rank", rank).filter("rank <= 5").select("qid", "vec_id", F.col("label").alias("cls"), "rank")
    plain = hits(V.search_many(rec, q, 6).filter("vec_id <> qid"))
    # the bound is a join on the class, before any ranking
    same = rec.join(F.broadcast(q), F.col("label") == F.col("qlabel")).filter("vec_id <> qid")
    bounded = hits(same.select("qid", "vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("sim")))
    ms = lambda name, a, b: q.select(F.lit(name).alias("strategy"), "qid", (F.col("qid") * a % b).cast("double").alias("ms"))
    return V.retrieval_metrics(plain, bounded, q.select("qid", F.col("qlabel").alias("expected")), ms("plain", 37, 101).unionByName(ms("bounded", 53, 89)))


@query("SELECT vec_id, cls, tier FROM (SELECT vec_id, concat('class', label) AS cls, (['Public', 'Internal', 'Confidential', 'Restricted'])[label % 4 + 1] AS tier FROM embeddings) WHERE tier <> 'Restricted'")
def federated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a partner with the highest ceiling sees: all but the highest tier."""
    return V.federated(records(spark, sf_dir), "Restricted").select("vec_id", "cls", "tier")


@query(r"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 / 10 END AS c FROM documents)
SELECT doc_id, c::DOUBLE AS confidence_score, (doc_id % 7)::DOUBLE AS evidence_volume, NULL::DOUBLE AS evidence_recency, NULL::DOUBLE AS cross_domain, 0.5::DOUBLE AS consistency_risk,
 len(list_filter(regexp_split_to_array(title, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::DOUBLE AS title_token_count, CASE WHEN doc_id % 5 > 0 THEN greatest(0, 86400 * (31 - doc_id % 40))::DOUBLE END AS age_seconds, NULL::DOUBLE AS regime_id FROM d""")
def ranker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric features of proposals made of the documents."""
    i = F.col("doc_id")
    made = F.when(i % 5 > 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 40).cast("int")), "yyyy-MM-dd'T'00:00:00.000")).otherwise("unknown")
    p = table(spark, sf_dir, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.when(i % 3 > 0, (i % 10 / 10).cast("string")).otherwise("n/a").alias("confidence_score"),
        (i % 7).alias("evidence_volume"), F.lit(0.5).alias("consistency_risk"), made.alias("created_at"))
    return models.ranker_features(p, "2024-02-01").select("doc_id", *models.RANKER_FEATURES)


@query("""SELECT c.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation c ON c_nationkey = c.n_nationkey JOIN region ON c.n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN part ON l_partkey = p_partkey
 WHERE p_size < 30 AND r_name <> 'ASIA' GROUP BY 1, 2""")
def cq_chain_of_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tables, seven joins: what suppliers' nations sell to customers' nations."""
    t = lambda n: table(spark, sf_dir, n)
    nation = lambda k: t("nation").select(F.col("n_nationkey").alias(f"{k}_key"), F.col("n_name").alias(f"{k}_nation"), F.col("n_regionkey").alias(f"{k}_region"))
    on = lambda a, b: F.col(a) == F.col(b)
    x = t("lineitem").join(t("part").filter("p_size < 30"), on("l_partkey", "p_partkey")).join(t("orders"), on("l_orderkey", "o_orderkey")).join(t("customer"), on("o_custkey", "c_custkey"))
    x = x.join(nation("customer"), on("c_nationkey", "customer_key")).join(t("region").filter("r_name <> 'ASIA'"), on("customer_region", "r_regionkey"))
    x = x.join(t("supplier"), on("l_suppkey", "s_suppkey")).join(nation("supplier"), on("s_nationkey", "supplier_key"))
    return x.groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("volume"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti join with rows at every size."""
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH t AS (SELECT concat(event_type, ' by ', user_id) AS template, ts < TIMESTAMP '2024-01-08' AS old FROM events),
n AS (SELECT template, count(*) AS hits FROM t WHERE NOT old AND template NOT IN (SELECT template FROM t WHERE old) GROUP BY 1)
SELECT template, hits, round(least(1, 0.3 + 0.05 * hits)::DOUBLE, 6) AS confidence FROM n WHERE hits >= 3""")
def fresh_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with a user that the first week lacks."""
    t = table(spark, sf_dir, "events").select(F.concat_ws(" by ", "event_type", "user_id").alias("template"), (F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).alias("old"))
    fresh = t.filter("not old").groupBy("template").agg(F.count("*").alias("hits")).filter("hits >= 3")
    fresh = fresh.join(t.filter("old").select("template").distinct(), "template", "left_anti")
    return fresh.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 + 0.05 * F.col("hits")), 6))
