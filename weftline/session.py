"""Session builder and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftline", cpus: int | None = None, **extra: str) -> SparkSession:
    """Local session with the settings that the engine expects on a cluster too.

    UTC keeps timestamps equal between engines, adaptive execution splits
    skewed joins, and small Arrow batches bound the memory of Python workers.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: list[str] = []  # a local session's own folder, which goes with the process


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again; the shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    path, before = scratch_folder(spark, label), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, deleted when the driver ends."""
    name = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; the folder goes with it
            pass

    atexit.register(delete)
    return name
