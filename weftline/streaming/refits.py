"""A rate detector whose baselines are refitted while it runs.

Each micro-batch of closed hourly counts is scored with the last 30 counts of
its (cluster, hour) and with the newest fitted baseline, then joins the kept
counts, and the fit runs on those. What is kept is bounded by clusters x hours x
30 whatever the length of the stream: a fit never reads the history again. State,
fits and scores of a batch are written under the batch's number from those of the
batch before, so a batch that is repeated after a failure replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rates import RateDetector, refit

COUNTS = "cluster string, hour int, day date, n long"
BASELINES = "cluster string, hour int, mu double, sd double"
KEEP = 2  # states and fits that stay, for a batch that is repeated


def _before(spark: SparkSession, path: str, kind: str, number: int, schema: str) -> DataFrame:
    """The table that the last batch before this one left."""
    fs, _ = _folder(spark, path)
    _, pattern = _folder(spark, f"{path}/{kind}/batch=*/_SUCCESS")
    done = [int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(pattern) or []]
    last = max((n for n in done if n < number), default=None)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/{kind}/batch={last}")


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _drop_before(spark: SparkSession, path: str, kind: str, number: int) -> None:
    fs, folder = _folder(spark, f"{path}/{kind}/batch=*")
    for f in fs.globStatus(folder) or []:
        if int(f.getPath().getName().split("=")[1]) <= number - KEEP:
            fs.delete(f.getPath(), True)


def scored(batch: DataFrame, kept: DataFrame, baselines: DataFrame) -> DataFrame:
    """batch(cluster, hour, day, n) with expected, sd, z, is_anomaly, direction and via: by the fit where there is one, else by
    the median and MAD of the last counts before it."""
    d = RateDetector
    past = W.partitionBy("cluster", "hour").orderBy("day").rowsBetween(-d.SIZE, -1)
    every = kept.select("cluster", "hour", "day", "n", F.lit(False).alias("_new")).unionByName(batch.select("cluster", "hour", "day", "n", F.lit(True).alias("_new")))
    x = every.withColumn("_past", F.collect_list(F.col("n").cast("double")).over(past)).filter("_new").join(baselines, ["cluster", "hour"], "left")
    middle = lambda a: (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2
    mid = F.coalesce(middle(F.col("_past")), F.lit(0.0))
    x = x.withColumn("_mid", mid)
    mad = F.coalesce(middle(F.transform("_past", lambda v: F.abs(v - F.col("_mid")))), F.lit(0.0))
    fitted = F.col("mu").isNotNull()
    x = x.withColumn("expected", F.when(fitted, F.col("mu")).otherwise(F.col("_mid"))).withColumn(
        "sd", F.greatest(F.when(fitted, F.col("sd")).otherwise(d.SCALE * mad), F.lit(d.FLOOR)))
    x = x.withColumn("z", (F.col("n") - F.col("expected")) / F.col("sd"))
    odd = (F.abs("z") >= d.LEAST_Z) & (F.size("_past") >= d.WARM)
    way = F.when(odd & (F.col("z") > 0), "spike").when(odd, "dip").otherwise("normal")
    return x.select("cluster", "hour", "day", "n", "expected", "sd", "z", odd.alias("is_anomaly"), way.alias("direction"),
                    F.when(fitted, "gp").otherwise("median_mad").alias("via"))


def last_counts(counts: DataFrame) -> DataFrame:
    """The last 30 counts of each cluster and hour."""
    w = W.partitionBy("cluster", "hour").orderBy(F.desc("day"))
    return counts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= RateDetector.SIZE).drop("_k")


def detect_and_refit(stream: DataFrame, path: str, checkpoint: str, fit=refit, **trigger):
    """Starts the detector over a stream of closed hourly counts(cluster, hour, day, n); scores are under path/scores."""
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = df.select(F.col("cluster").cast("string"), F.col("hour").cast("int"), "day", F.col("n").cast("long")).persist()
        kept, baselines = _before(spark, path, "state", number, COUNTS), _before(spark, path, "fit", number, BASELINES)
        scored(new, kept, baselines).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")
        last_counts(kept.unionByName(new)).write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        now = spark.read.schema(COUNTS).parquet(f"{path}/state/batch={number}")
        fit(now).write.mode("overwrite").parquet(f"{path}/fit/batch={number}")
        new.unpersist()
        for kind in ("state", "fit"):
            _drop_before(spark, path, kind, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
