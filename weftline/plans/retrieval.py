"""Retrieval queries: the label is the class, label % 4 the tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.functions.vector import hash_embedding
from weftline.operators import vectors as V
from weftline.session import table

PROBE = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_DUCK = "[" + ", ".join(repr(x) for x in PROBE) + "]::DOUBLE[]"
_COS = f"round(list_dot_product(e, {_DUCK}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_DUCK}, {_DUCK}))), 6)"
REC = """r AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, concat('class', label) AS cls, (['Public', 'Internal', 'Confidential', 'Restricted'])[label % 4 + 1] AS tier,
 CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 10) / 10 END AS confidence, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 60 END AS age_days FROM embeddings)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = F.array(*[F.lit(t) for t in V.TIERS])
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label", F.concat(F.lit("class"), F.col("label")).alias("cls"),
        F.element_at(tiers, (F.col("label") % 4 + 1).cast("int")).alias("tier"),
        F.when(F.col("vec_id") % 5 != 0, (F.col("vec_id") % 10) / 10).alias("confidence"),
        F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 60).alias("age_days"),
    )


@query(f"WITH {REC} SELECT vec_id, cls, {_COS} AS sim FROM r ORDER BY sim DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest records without a filter."""
    return V.search(records(spark, sf_dir), PROBE, 10).select("vec_id", "cls", "sim")


@query(f"WITH {REC} SELECT vec_id, cls, tier, {_COS} AS sim FROM r WHERE tier IN ('Public', 'Internal') AND cls IN ('class0', 'class1', 'class5') ORDER BY sim DESC, vec_id LIMIT 10")
def vector_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest records within classes and a tier's ceiling."""
    x = V.allowed(records(spark, sf_dir), "Internal", ["class0", "class1", "class5"])
    return V.search(x, PROBE, 10).select("vec_id", "cls", "tier", "sim")


@query(f"""WITH {REC}, h AS (SELECT *, {_COS} AS sim FROM r ORDER BY sim DESC, vec_id LIMIT 30)
SELECT vec_id, sim, round(sim * coalesce(least(greatest(confidence, 0.1), 1.0), 1.0) * coalesce(pow(0.5, age_days / 30.0), 1.0), 6) AS score FROM h ORDER BY score DESC, vec_id LIMIT 10""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times as many hits as wanted, ranked again by confidence and age."""
    return V.composite(V.search(records(spark, sf_dir), PROBE, 10, 3), 10).select("vec_id", "sim", "score")


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, label AS ql FROM embeddings ORDER BY vec_id LIMIT 20),
x AS (SELECT qid, ql, vec_id, label, round(list_dot_product(q, e) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS sim FROM q, (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings) WHERE vec_id <> qid),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM x)
SELECT round(avg(p), 6) AS precision_at_5, round(avg(rr), 6) AS mrr FROM (SELECT qid, count(*) FILTER (label = ql) / 5.0 AS p, coalesce(max(CASE WHEN label = ql THEN 1.0 / rank END), 0) AS rr FROM k WHERE rank <= 5 GROUP BY 1)""")
def retrieval_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at 5 and mean reciprocal rank of a benchmark's twenty probes (a fixed set, as the benchmark states it)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(20).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("qlabel"))
    hits = V.search_many(e, q, 6).filter("vec_id <> qid")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")))
    hit = F.col("label") == F.col("qlabel")
    by = hits.filter("rank <= 5").groupBy("qid").agg(
        (F.count_if(hit) / 5.0).alias("p"), F.coalesce(F.max(F.when(hit, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return by.agg(F.round(F.avg("p"), 6).alias("precision_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("""WITH a AS (SELECT page_id AS iri, md5(html) AS content_hash FROM pages), i AS (SELECT page_id AS iri, CASE WHEN page_id % 4 = 0 THEN 'old' ELSE md5(html) END AS content_hash FROM pages)
SELECT iri, content_hash FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.iri = a.iri AND i.content_hash = a.content_hash)""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose content isn't in the index yet."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("iri"), F.md5("html").alias("content_hash"))
    index = p.withColumn("content_hash", F.when(F.col("iri") % 4 == 0, "old").otherwise(F.col("content_hash")))
    return V.unchanged_removed(p, index)


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of the benchmark's texts."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), 0)
    return table(spark, sf_dir, "benchmark").select("item_id", hash_embedding()(toks).alias("v"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS j
FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) * 10 >= len(list_distinct(list_concat(a.w, b.w))) * 2""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that share a fifth of their tokens, joined on the tokens."""
    t = table(spark, sf_dir, "benchmark").select(
        "item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), 0)).alias("w"))
    x = t.select("item_id", F.size("w").alias("n"), F.explode("w").alias("w"))
    a = x.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "w")
    b = x.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "w")
    s = a.join(b, "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    either = F.col("na") + F.col("nb") - F.col("k")
    return s.filter(F.col("k") * 10 >= either * 2).select("a", "b", F.round(F.col("k") / either, 6).alias("j"))
