"""Streaming operators, run over the tables as one available batch or as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalogue import query
from weftline.session import scratch_folder, table
from weftline.streaming import rates as R


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of half an hour."""
    s = R.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("""WITH h AS (SELECT event_type AS cluster, CAST(hour(ts) AS INT) AS hour, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3),
x AS (SELECT *, list(n) OVER (PARTITION BY cluster, hour ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l FROM h),
m AS (SELECT *, coalesce(list_median(l), 0)::DOUBLE AS mid FROM x),
d AS (SELECT *, greatest(coalesce(1.4826 * list_median(list_transform(l, lambda v: abs(v - mid))), 0.5), 0.5)::DOUBLE AS s FROM m)
SELECT cluster, hour, day, n, round(mid, 6) AS expected, round(s, 6) AS sd, round((n - mid) / s, 6) AS z,
 CASE WHEN coalesce(len(l), 0) < 3 OR abs((n - mid) / s) < 2.576 THEN 'normal' WHEN n > mid THEN 'spike' ELSE 'dip' END AS direction FROM d""")
def rate_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online detector over the hourly counts of all events."""
    from weftline.operators.series import hourly_counts

    hourly = hourly_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "cluster"), "cluster", "ts")
    path = scratch_folder(spark, "hourly")
    hourly.write.parquet(path)
    found = _update(spark, R.detect_rates(spark.readStream.schema(hourly.schema).parquet(path)))
    return found.select("cluster", "hour", "day", "n", *[F.round(c, 6).alias(c) for c in ("expected", "sd", "z")], "direction")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _update(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """An update-mode stream, each batch written under its number; the session's state store is put back."""
    root, before = scratch_folder(spark, "stream"), spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out/batch={i}")).outputMode("update").option(
            "checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query()
def refitted_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts in batches of days; each batch is scored by the baselines fitted on those before it."""
    from weftline.operators.series import hourly_counts
    from weftline.streaming import refits

    hourly = hourly_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "cluster"), "cluster", "ts").select(
        "cluster", F.col("hour").cast("int"), "day", F.col("n").cast("long").alias("n"))
    root = scratch_folder(spark, "refits")
    for part in range(3):  # three files in their order: days of the first, second and last third of a month
        some = hourly.filter(F.least(F.floor((F.dayofmonth("day") - 1) / 10), F.lit(2)) == part).coalesce(1)
        some.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(refits.COUNTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    refits.detect_and_refit(stream, f"{root}/out", f"{root}/log").awaitTermination()
    schema = "cluster string, hour int, day date, n long, expected double, sd double, z double, is_anomaly boolean, direction string, via string, batch long"
    return spark.read.schema(schema).parquet(f"{root}/out/scores")
