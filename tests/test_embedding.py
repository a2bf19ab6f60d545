"""Template vectors over all words against a plain decomposition."""

import re

import numpy as np

from weftline.operators import models


def plain(texts, k):
    bags = [re.findall("[a-z_]{2,}", (t or "").lower()) for t in texts]
    words = sorted({w for b in bags for w in b})
    x = np.array([[b.count(w) for w in words] for b in bags], float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    p = x @ v[:k].T
    size = np.linalg.norm(p, axis=1, keepdims=True)
    return np.where(size > 1e-12, p / np.maximum(size, 1e-300), 0)


def test_vectors_equal_a_plain_decomposition(spark):
    rng = np.random.RandomState(4)
    parts = [["login", "failed", "for", "user"], ["disk", "full", "on", "node", "node"], ["link", "down", "port"], ["job", "done", "in", "time", "ok"]]
    texts = []
    for i, p in enumerate(parts):  # directions of clearly different variance
        for _ in range((40, 25, 14, 7)[i]):
            texts.append(" ".join(p + [f"w_{''.join(rng.choice(list('abcdef'), 3))}"]))
    texts += ["", None, "<*> 12 !", texts[0]]
    rows = list(enumerate(texts))
    t = spark.createDataFrame(rows, "i int, template string").repartition(4)
    got = {r.i: np.array(r.v) for r in models.template_vectors(t, 3).collect()}
    want = plain(texts, 3)
    assert len(got) == len(texts) and all(len(v) == 3 for v in got.values())
    mine = np.stack([got[i] for i in range(len(texts))])
    np.testing.assert_allclose(mine @ mine.T, want @ want.T, atol=2e-3)
    assert not mine[texts.index("")].any() and not mine[texts.index(None)].any()


def test_more_words_than_any_width(spark):
    """6,000 words that come once, none pooled with another."""
    from pyspark.sql import functions as F

    word = F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij")
    pairs = spark.range(6_000).select(F.concat(F.lit("red "), word).alias("template"))
    near = spark.range(1).select(F.lit("blue sky blue sea").alias("template"))
    got = models.template_vectors(pairs.unionByName(near), 2, rounds=4)
    assert got.count() == 6_001
    assert got.filter("abs(sqrt(v[0] * v[0] + v[1] * v[1]) - 1) > 1e-9").count() == 0


def test_tables_without_words(spark):
    t = spark.createDataFrame([("12",), (None,)], "template string")
    assert [list(r.v) for r in models.template_vectors(t).collect()] == [[], []]
    assert models.template_vectors(t.limit(0)).count() == 0
    one = spark.createDataFrame([("ab",)], "template string")
    assert [len(r.v) for r in models.template_vectors(one).collect()] == [1]
    same = spark.createDataFrame([("red sky",), ("sky red",)], "template string")
    assert [round(r.distance, 9) for r in models.nearest_templates(models.template_vectors(same)).collect()] == [0.0]
