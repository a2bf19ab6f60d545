"""What the corpus operators share: tables, scratch Parquet in the shared folder, fixed-size filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; the class is the same in every operator.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what a Python worker holds: few rows in an Arrow batch, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a written table for each file, where its size is known.
FILE_ROWS = 20_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the cluster's shared folder: cut lineage, and survive lost executors.

    The folder is spark.checkpoint.dir; only where that is unset (a local
    session) a temporary folder is made. All is deleted when the driver ends,
    single tables as soon as ``drop`` is called.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            base = tempfile.mkdtemp(prefix="weftline-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
        """Writes and rereads df; where its size is known about, small tables get few files.

        The write's own shuffle files go as soon as it ends: nothing reads them again.
        """
        if rows is not None:
            df = df.coalesce(rows // FILE_ROWS + 1)
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").options(**options).parquet(path)
        finally:
            conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has ended; the folder goes with it
            pass


class Bloom:
    """Filter over a key column, a written table: about 16 bits for each key, 16 MB (MAX_BITS) at most.

    That bounds what is collected and broadcast. Up to 8 million keys 1 in 400
    other rows passes; beyond, more rows pass, and none is lost: with 40 million
    keys about half, with 200 million nearly all, and those take the join.
    """

    HASHES, MAX_BITS = 4, 27

    def __init__(self, keys: DataFrame, column: str, bits: int | None = None):
        if bits is None:
            bits = 1 << min(self.MAX_BITS, max(16, (16 * keys.count()).bit_length()))
        self.bits, self.spark = bits, keys.sparkSession
        at = [F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(bits)) for i in range(self.HASHES)]
        words = (
            keys.select(F.explode(F.array(*at)).alias("p"))
            .groupBy(F.shiftright("p", 5).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b"))
            .toPandas()
        )
        self.words = np.zeros(bits // 32, np.uint32)
        self.words[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)

    def flag(self, column: str):
        """Column: may the key be in the filter? Only bit positions go to Python, other columns stay in the JVM."""
        bits = self.spark.sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def held(p0: pd.Series, p1: pd.Series, p2: pd.Series, p3: pd.Series) -> pd.Series:
            hit = None
            for p in (p0, p1, p2, p3):
                p = p.to_numpy(np.int64)
                one = (bits.value[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1
                hit = one if hit is None else hit & one
            return pd.Series(hit)

        return held(*[F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(self.bits)) for i in range(self.HASHES)])


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first longer one that no column of df has (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, scratch: Scratch, repeatable: bool = False) -> tuple[DataFrame, str]:
    """docs with a column that no two rows share, and its name: hash of the row's file, and its place in that file.

    A table that is read from Parquet has both for nothing, the same in every
    job; any other is written first. ``repeatable`` puts a hash of the row's
    columns before them, so that the first of several keys means an equal row
    wherever the table lies (maps and variants are left out of it).
    """
    key = free_name(docs, "row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = scratch.save(docs, f"{key}s")
    at = docs.metadataColumn("_metadata")
    place = [F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("i")]
    if repeatable:
        hashed = [c for c, t in docs.dtypes if c != key and "map<" not in t and "variant" not in t]
        place.insert(0, F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in hashed]).alias("h"))
    place = F.struct(*place)
    return docs.select("*", place.alias(key)), key


def without_rows(docs: DataFrame, key: str, dropped: DataFrame, bits: int | None = None) -> DataFrame:
    """docs without the rows whose key is in dropped(key), a written table, and without the key.

    Rows that a filter of bounded size tells apart pass without a shuffle; only
    those that may be dropped are joined.
    """
    flag = free_name(docs, "maybe")
    maybe = F.col(flag)
    columns = [c for c in docs.columns if c != key]
    flagged = docs.withColumn(flag, Bloom(dropped, key, bits).flag(key))
    joined = flagged.filter(maybe).join(dropped.select(key), key, "left_anti")
    return flagged.filter(~maybe).select(*columns).unionByName(joined.select(*columns))
