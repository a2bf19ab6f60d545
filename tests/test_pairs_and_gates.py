"""Pair counts under skew, ranks with outliers, what may run as a query, policies, names that are near."""

import collections
import random

import pytest

from weftline.operators import gates, range_join, ranks, text_match


def plain_pairs(rows, width):
    want = collections.Counter()
    for a, t in rows:
        for b, u in rows:
            if 0 < u - t <= width:
                want[a, b, "later"] += 1
            elif u == t:
                want[a, b, "same"] += 1
    return want


@pytest.mark.parametrize("shape", ["sparse", "repeats", "mixed"])
def test_pair_counts_in_sparse_and_dense_buckets(spark, shape, monkeypatch):
    monkeypatch.setattr(range_join, "SLICE", 20)
    rnd = random.Random(2)
    rows = []
    if shape != "repeats":
        rows += [(f"u{rnd.randint(0, 30)}", rnd.randint(0, 3000)) for _ in range(120)]
    if shape != "sparse":
        rows += [(rnd.choice("AB"), rnd.randint(5000, 5100)) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = collections.Counter()
    for r in range_join.ordered_pair_counts(df, "k", "t", 60).collect():
        got[r.x, r.y, "later"] += r.later
        got[r.x, r.y, "same"] += r.same
    assert +got == plain_pairs(rows, 60)


def test_ten_thousand_entities_in_a_minute(spark):
    n = 10_000
    df = spark.range(n).selectExpr("concat('e', id) as k", "id div 100 as t")  # 100 at once, 60 times a bucket
    got = range_join.ordered_pair_counts(df, "k", "t", 2).selectExpr("sum(later) as later", "sum(same) as same", "count(*) as pairs").first()
    assert got.same == n * 100 and got.later == 100 * 100 * (99 + 98) and got.pairs == got.same + got.later


def test_one_outlier_leaves_ranks_spread(spark):
    values = [float(i % 997) + i / 1e6 for i in range(20_000)] + [1e12, float("inf"), float("-inf"), float("nan"), None, -1e-9, 0.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, id long")
    got = {r.id: r["rank"] for r in ranks.ranked(df, [], "v", ["id"]).collect()}
    key = lambda i: (values[i] is not None, values[i] != values[i], 0 if values[i] is None or values[i] != values[i] else values[i], i)
    assert [got[i] for i in sorted(range(len(values)), key=key)] == list(range(len(values)))
    bins = ranks.ranked(df, [], "v", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_a" in bins and "_b" in bins
    from pyspark.sql import functions as F
    x = df.withColumn("u", F.signum("v") * F.log1p(F.abs("v"))).filter("abs(v) < 1e13")
    lo, hi = x.agg(F.min("u"), F.max("u")).first()
    a = x.withColumn("a", ranks._cut(F.col("u"), F.lit(lo), F.lit(hi), ranks.BINS))
    span = a.groupBy("a").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    most = a.join(span, "a").groupBy("a", ranks._cut(F.col("v"), F.col("lo"), F.col("hi"), ranks.BINS).alias("b")).count().agg(F.max("count")).first()[0]
    assert most < 600  # of 20,000; with one level of equal widths all of them share a bin


REFUSED = [
    "TRUNCATE TABLE t0", "REPLACE TABLE x USING parquet AS SELECT 1 AS a", "WITH q AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM q",
    "LOAD DATA INPATH '/tmp/x' INTO TABLE x", "EXECUTE IMMEDIATE 'SELECT 1'", "CALL p()", "CACHE TABLE t0", "UNCACHE TABLE t0",
    "REFRESH TABLE t0", "ANALYZE TABLE t0 COMPUTE STATISTICS", "MSCK REPAIR TABLE x", "SELECT reflect('java.lang.System', 'nanoTime')",
    "SELECT 1 WHERE 1 = (SELECT cast(java_method('java.lang.Math', 'abs', 1) AS int))", "SELECT * FROM called",
    "WITH q AS (SELECT try_reflect('java.lang.System', 'nanoTime') AS a) SELECT * FROM q", "DROP TABLE IF EXISTS x", "SET a=b", "RESET",
    "CREATE VIEW v AS SELECT 1", "ADD JAR '/tmp/x.jar'", "DELETE FROM x", "UPDATE x SET a = 1", "INSERT INTO x VALUES (1)", "USE x",
    "MERGE INTO x USING t0 ON x.id = t0.id WHEN MATCHED THEN DELETE", "FROM t0 INSERT INTO x SELECT *", "EXPLAIN SELECT 1",
    "SELECT TRANSFORM(id) USING 'cat' AS (a) FROM t0", "SHOW TABLES",
]
ALLOWED = [
    "WITH q AS (SELECT id FROM t0) SELECT a.id, count(*) AS n FROM q a JOIN q b ON a.id = b.id GROUP BY a.id HAVING count(*) > 0 ORDER BY 1 LIMIT 5",
    "SELECT id FROM t0 UNION SELECT id + 1 FROM t0 EXCEPT SELECT 1", "SELECT id FROM t0 INTERSECT SELECT id FROM t0",
    "SELECT * FROM t0 WHERE id IN (SELECT id FROM t0) AND EXISTS (SELECT 1 FROM t0 b WHERE b.id = t0.id) AND id < (SELECT max(id) FROM t0)",
    "SELECT id, row_number() OVER w AS k FROM t0 WINDOW w AS (ORDER BY id)", "SELECT * FROM VALUES (1, 2), (3, 4) AS v(a, b)",
    "SELECT * FROM t0 LATERAL VIEW explode(array(1, 2)) e AS y", "SELECT * FROM t0, LATERAL (SELECT t0.id + 1 AS k)",
    "SELECT /*+ BROADCAST(t0) */ * FROM t0", "SELECT k, count(*) FROM (SELECT id % 2 AS k FROM t0) GROUP BY ROLLUP(k)",
    "SELECT * FROM (SELECT id, id % 2 AS k FROM t0) PIVOT (count(id) FOR k IN (0, 1))", "SELECT * FROM range(3)",
]


@pytest.fixture(scope="module")
def views(spark):
    spark.range(3).createOrReplaceTempView("t0")
    spark.sql("CREATE OR REPLACE TEMP VIEW called AS SELECT reflect('java.lang.System', 'nanoTime') AS a")


@pytest.mark.parametrize("text", REFUSED)
def test_commands_are_refused(spark, views, text):
    with pytest.raises(PermissionError):
        gates.read_only(spark, text)
    assert spark.table("t0").count() == 3


@pytest.mark.parametrize("text", ALLOWED)
def test_queries_run(spark, views, text):
    assert gates.read_only(spark, text).collect()


def test_policy_text_in_quotes(spark):
    df = spark.createDataFrame([("salt and pepper", "a, b"), ("salt", "c")], "name string, tag string")
    hit = lambda p: [r.x for r in df.select(gates.policy(p).alias("x")).collect()]
    assert hit("name contains 'salt and pepper'") == [True, False]
    assert hit("name contains 'salt' and tag in ('a, b', c)") == [True, True]
    assert hit("name == \"salt AND pepper\" and tag == c") == [False, False]
    assert hit("tag not in (c) AND name startswith salt") == [True, False]


def test_texts_that_contain_patterns(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 4)))
    patterns, texts = sorted({word() for _ in range(60)}), ["".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, None)], "i int, t string")
    some = spark.createDataFrame([(p,) for p in [*patterns, "", patterns[0]]], "p string")
    want = {(i, p) for i, t in enumerate(texts) for p in patterns if p in t}
    for shard in (100_000, 9):
        got = [(r.i, r.pattern) for r in text_match.containing(rows, "t", some, shard=shard).collect()]
        assert set(got) == want and len(got) == len(want)


def test_names_near_titles(spark):
    rnd = random.Random(5)
    make = lambda: " ".join(rnd.choice(["Air", "line", "airline", "Big", "hub", "ub"]) for _ in range(rnd.randint(1, 3)))
    titles, names = sorted({make() for _ in range(30)}), sorted({make() for _ in range(25)})

    def likeness(t, n):
        t, n = t.lower(), n.lower()
        if n in t or t in n:
            return 0.7
        a, b = set(t.split()), set(n.split())
        return len(a & b) / len(a | b)

    got = gates.nearest_names(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame([(n,) for n in names], "name string"))
    got = {r.title: r._near for r in got.collect()}
    assert all(got.get(t, 0.0) == pytest.approx(max(likeness(t, n) for n in names)) for t in titles)
