"""Vector functions on arrays, in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hash_embedding(dim: int = 384, per_token: int = 4):
    """Pandas function: tokens -> vector with per_token signed buckets of SHA-256 for each token, of length 1."""
    import hashlib

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[tuple[int, float]]] = {}

        def places(token: str) -> list[tuple[int, float]]:
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                d = hashlib.sha256(token.encode()).digest()
                known[token] = [
                    (int.from_bytes(d[8 * i : 8 * i + 4], "big") % dim, 1.0 if d[8 * i + 4] & 1 else -1.0) for i in range(per_token)
                ]
            return known[token]

        for s in batches:
            out = []
            for tokens in s:
                v = np.zeros(dim, np.float32)
                for t in tokens if tokens is not None else ():
                    for at, sign in places(t):
                        v[at] += sign
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.Series(out)

    return embed
