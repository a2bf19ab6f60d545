"""Rules as files of Spark SQL over a view ``triples``, run until they give nothing new.

Each file holds one query with columns s, p and o; its name is the rule's. Files
are read by Spark, so a folder may lie in any store it reaches, and queries
pass the read-only guard before they run.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gates import read_only
from .graph import cut


def rules_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name without .sql -> query, in the order of names. A folder of rules is small: they come to the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(folder)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.sql$", 1).alias("name"), F.col("content").cast("string").alias("text"))
    return {r["name"]: r["text"].strip().rstrip(";") for r in rows.orderBy("name").collect()}


def run_rules(triples: DataFrame, rules: dict[str, str], rounds: int = 100) -> DataFrame:
    """(s, p, o, rule, round) of what the rules derive from triples(s, p, o) and from each other; the first derivation stays.

    In each round all rules see all that is known. A fact that several rules give in a round has the first rule's name.
    """
    spark = triples.sparkSession
    known = cut(triples.select("s", "p", "o").distinct().withColumn("rule", F.lit(None).cast("string")).withColumn("round", F.lit(0)))
    view = f"triples_{uuid.uuid4().hex}"
    # the name stands for the view of this run in every query, as a common table
    texts = {name: f"WITH triples AS (SELECT s, p, o FROM {view}) SELECT s, p, o FROM ({text}\n)" for name, text in rules.items()}
    try:
        for turn in range(1, rounds + 1):
            known.createOrReplaceTempView(view)
            made = [read_only(spark, t).selectExpr("cast(s as string) s", "cast(p as string) p", "cast(o as string) o").withColumn("rule", F.lit(n)) for n, t in texts.items()]
            if not made:
                break
            got = reduce(DataFrame.unionByName, made).filter("s is not null and p is not null and o is not null").groupBy("s", "p", "o").agg(F.min("rule").alias("rule"))
            new = cut(got.join(known, ["s", "p", "o"], "left_anti").withColumn("round", F.lit(turn)))
            if new.isEmpty():
                break
            known = known.unionByName(new)
    finally:
        spark.catalog.dropTempView(view)
    return known.filter("round > 0")
