"""Exact duplicates through a log-structured merge index of text digests.

Insert: each task keeps a memtable (digest -> smallest id, rows) of bounded
size and flushes it as a sorted run; runs are Parquet in the shared folder,
with a filter (Parquet's bloom filter on the digest) for each run's row groups.
Compaction merges the runs since the last one, and the level below them, in
digest order: one entry for each digest with the smallest id and the number of
rows, in files of disjoint digest ranges, again with filters. A merged run is
never merged again. Point lookups (``find``) read only the row groups of runs
and level whose filter and range hold a digest asked for.

Resolving a whole table: a filter of bounded size over the digests that occur
more than once tells most rows, without a shuffle, that they are alone; the
others join the index, and the bytes of each group are compared (smallest text
= largest text). A digest under which texts differ is split by the text itself.

A group of copies that holds a third of all rows is combined in the memtables
and again before each shuffle; the final join has one index row for each
digest, so adaptive execution can split its rows.

Edge cases: null counts as empty text; an empty or very long text is a text
like any other; rows that repeat an id and a text share one result (kept for
all of them if their id is the smallest; ``later_copies`` keeps one of them); a
null id is never the smallest unless all are null; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, Scratch

RUN = "digest binary, keep_id long, n long"
FILTERED = {"parquet.bloom.filter.enabled#digest": "true"}
MEMTABLE_ROWS = 100_000


def normalise(text: Column) -> Column:
    """Runs of white space become one space; single spaces are left alone, which saves most replacements."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_of(norm: Column, bits: int = 256) -> Column:
    full = F.unhex(F.sha2(norm, 256))
    return full if bits == 256 else F.substring(full, 1, bits // 8)


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _entries(keys: list[bytes], ids: list[int | None], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["digest", "keep_id", "n"]
    )


def _memtables(limit: int):
    def flush(table: dict) -> pa.RecordBatch:
        keys = sorted(table)
        return _entries(keys, [table[k][0] for k in keys], [table[k][1] for k in keys])

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple[int | None, int]] = {}
        for batch in batches:
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, n = table.get(key, (None, 0))
                table[key] = (_smaller(low, i), n + 1)
            if len(table) >= limit:
                yield flush(table)
                table = {}
        if table:
            yield flush(table)

    return insert


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in digest order, all of a digest in one task -> one entry for each digest, in the same order."""
    key, low, n = None, None, 0
    for batch in batches:
        keys, ids, counts = [], [], []
        for k, i, c in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            if k == key:
                low, n = _smaller(low, i), n + c
                continue
            if key is not None:
                keys.append(key)
                ids.append(low)
                counts.append(n)
            key, low, n = k, i, c
        yield _entries(keys, ids, counts)
    if key is not None:
        yield _entries([key], [low], [n])


class DigestIndex:
    """The index: sorted runs by insert, one sorted level by compact."""

    def __init__(self, spark: SparkSession, scratch: Scratch, memtable_rows: int = MEMTABLE_ROWS, bits: int = 256):
        self.spark, self.scratch, self.memtable_rows, self.bits = spark, scratch, memtable_rows, bits
        self.runs: dict[str, DataFrame] = {}  # not merged yet
        self.level: DataFrame | None = None
        self._level_name: str | None = None
        self.made = 0

    def _save(self, df: DataFrame, kind: str) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"{kind}{self.made}"
        return name, self.scratch.save(df, name, **FILTERED)

    def insert(self, docs: DataFrame) -> None:
        """docs(doc_id, text): flush their runs."""
        keys = docs.select(F.col("doc_id").cast("long"), digest_of(normalise(F.col("text")), self.bits).alias("digest"))
        name, run = self._save(keys.mapInArrow(_memtables(self.memtable_rows), RUN), "run")
        self.runs[name] = run

    def _entries(self) -> DataFrame:
        out = self.level
        for run in self.runs.values():
            out = run if out is None else out.unionByName(run)
        return out

    def compact(self) -> DataFrame:
        """Merges the runs since the last compaction into the level: (digest, keep_id, n). Merged runs are deleted."""
        if not self.runs:
            return self.level
        # a digest's entries are as many as the runs that hold it, however many rows it has
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = self._entries().repartitionByRange(parts, "digest").sortWithinPartitions("digest")
        before = self._level_name
        self._level_name, self.level = self._save(ordered.mapInArrow(_merge, RUN), "level")
        self.scratch.drop(*self.runs, *([before] if before else []))
        self.runs = {}
        return self.level

    def find(self, digests: list[bytes]) -> DataFrame:
        """(digest, keep_id, n) of the digests that were inserted, merged or not; filters skip what can't hold them."""
        rows = self._entries().filter(F.col("digest").isin(digests))
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def resolve(self, docs: DataFrame, filter_bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256, carried columns) for each row of docs, which must have been inserted."""
        save = self.scratch.save
        level = self.compact()
        several = level.filter("n > 1")
        bloom = Bloom(several, "digest", filter_bits)
        norm = normalise(F.col("text"))
        rows = docs.select(F.col("doc_id").cast("long"), norm.alias("norm"), *carry)
        rows = rows.withColumn("full", F.unhex(F.sha2("norm", 256)))
        rows = rows.withColumn("digest", F.col("full") if self.bits == 256 else F.substring("full", 1, self.bits // 8))
        rows = rows.withColumn("maybe", bloom.flag("digest"))
        rows = save(rows.withColumn("norm", F.when(F.col("maybe"), F.col("norm"))), "looked_up")
        alone, maybe = rows.filter(~F.col("maybe")), rows.filter("maybe")
        bytes_of = maybe.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        same = bytes_of.select("digest", (F.col("lo") == F.col("hi")).alias("same"))
        # written as it is dealt: the texts that are compared come in with the rows of this table, few as they are
        index = save(several.join(same, "digest"), "verified")
        out = ["doc_id", "full", "keep_id", "n", *carry]
        lone = alone.withColumns({"keep_id": F.col("doc_id"), "n": F.lit(1).cast("long")})
        found = maybe.join(index.withColumnRenamed("n", "n_all"), "digest", "left")
        differs = F.coalesce(~F.col("same"), F.lit(False))
        hit = found.filter(~differs).withColumns({
            "keep_id": F.when(F.col("same"), F.col("keep_id")).otherwise(F.col("doc_id")), "n": F.coalesce("n_all", F.lit(1)),
        })
        parts = lone.select(*out).unionByName(hit.select(*out))
        if not index.filter("not same").isEmpty():  # one digest, several texts
            split = save(found.filter(differs).select("doc_id", "full", "digest", "norm", *carry), "collided")
            groups = split.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
            parts = parts.unionByName(split.join(groups, ["digest", "norm"]).select(*out))
        return parts.select(
            "doc_id", "keep_id", F.col("n").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"), *carry,
        )


def exact_dedup(docs: DataFrame, scratch: Scratch, carry: tuple[str, ...] = (), **settings) -> DataFrame:
    """Build the index over docs(doc_id, text) and look every row up."""
    index = DigestIndex(docs.sparkSession, scratch, **settings)
    index.insert(docs)
    return index.resolve(docs, carry=carry)


def later_copies(docs: DataFrame, key: str, scratch: Scratch, **settings) -> DataFrame:
    """(key) of the rows of docs(doc_id, text, key) to drop: all of a group of equal texts but one.

    The row with the smallest id stays (of null ids, and of rows that repeat
    it, the first by key).
    """
    docs = docs.select("doc_id", "text", F.col(key).alias("row"))
    found = scratch.save(exact_dedup(docs, scratch, ("row",), **settings).filter("group_size > 1"), "copies")
    first = found.filter("kept").groupBy("text_sha256").agg(F.min("row").alias("row"))
    return found.join(first, "row", "left_anti").select(F.col("row").alias(key))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
