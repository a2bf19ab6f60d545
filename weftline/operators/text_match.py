"""Which of many patterns a text holds: one scan of each text for all patterns of a shard, never a join of all with all."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 100_000  # patterns that one broadcast holds
_automata: dict = {}  # of the shards that this worker has met last


def _automaton(key: str, patterns: list[str]):
    if key not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in patterns:
            a.add_word(p, p)
        a.make_automaton()
        if len(_automata) >= 4:
            _automata.pop(next(iter(_automata)))
        _automata[key] = a
    return _automata[key]


def _finder(shared, key: str):
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        if not shared.value:
            return pd.Series([[] for _ in texts])
        a = _automaton(key, shared.value)
        return pd.Series([[] if t is None else sorted({p for _, p in a.iter(t)}) for t in texts])

    return found


def containing(rows: DataFrame, text: str, patterns: DataFrame, name: str = "pattern", shard: int = SHARD) -> DataFrame:
    """rows with a column more: a row for each different pattern (first column of patterns, "" left out) that text contains.

    Patterns are taken in shards of about ``shard`` by hash; each is a broadcast of that size and one scan of rows.
    """
    spark, column = rows.sparkSession, patterns.columns[0]
    wanted = patterns.select(F.col(column).alias("p")).filter("p <> ''").distinct()
    shards = wanted.count() // shard + 1
    out = None
    for i in range(shards):
        some = [r["p"] for r in wanted.filter(F.pmod(F.xxhash64("p"), F.lit(shards)) == i).toLocalIterator()]
        shared, key = spark.sparkContext.broadcast(some), uuid.uuid4().hex

        found = _finder(shared, key)
        part = rows.withColumn(name, F.explode(found(F.col(text))))
        out = part if out is None else out.unionByName(part)
    return out
