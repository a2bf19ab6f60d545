"""The vector store under failures and several writers; a detector whose baselines are refitted; compression of memory."""

import collections
import datetime
import os
import threading

import numpy as np
import pandas as pd
import pytest

from weftline.operators import memory, stores
from weftline.streaming import rates, refits

SCHEMA = "vec_id long, embedding array<float>, tier string, cls string"


@pytest.fixture
def store(spark, tmp_path):
    return stores.ParquetStore(spark, str(tmp_path / "v"), SCHEMA)


def rows(spark, *ids, cls="a"):
    return spark.createDataFrame([(i, [float(i), 1.0], "Public", cls) for i in ids], SCHEMA)


def held(store, version=None):
    return {r.vec_id: r.cls for r in store.read(version).collect()}


def test_a_crashed_writer_blocks_nobody(spark, store):
    assert held(store) == {} and store.version() == 0
    store.upsert(rows(spark, 1, 2))
    store._write(rows(spark, 9), False)  # written, never committed
    os.makedirs(f"{store.path}/data/half")  # not even written
    open(f"{store.path}/log/000000002", "w").close()  # a number taken, its commit never made
    assert held(store) == {1: "a", 2: "a"}
    assert store.upsert(rows(spark, 3)) == 3 and held(store) == {1: "a", 2: "a", 3: "a"}
    store.compact()
    assert len(store.vacuum(hours=0)) == 4 and held(store) == {1: "a", 2: "a", 3: "a"} and store.vacuum(hours=0) == []


def test_changes_write_what_changed(spark, store):
    store.upsert(rows(spark, *range(100)))
    store.upsert(rows(spark, 5, 7, cls="b"))
    store.delete(spark.createDataFrame([(8,), (8,), (1000,)], "vec_id long"))
    sizes = {c["number"]: store._load(c).count() for c in store._commits()}
    assert sizes == {1: 100, 2: 2, 3: 2}
    want = {i: "b" if i in (5, 7) else "a" for i in range(100) if i != 8}
    assert held(store) == want and held(store, 1) == dict.fromkeys(range(100), "a") and held(store, 2)[8] == "a"
    store.upsert(rows(spark, 8, cls="c"))
    store.compact()
    store.delete(rows(spark, 9))
    want[8] = "c"
    del want[9]
    assert held(store) == want and store.version() == 6 and held(store, 3).keys() == set(range(100)) - {8}


def test_equal_keys_leave_one_row(spark, store):
    store.upsert(rows(spark, 1, 1, 1).unionByName(rows(spark, 1, cls="b")))
    assert store.count() == 1


def test_writers_lose_nothing(spark, store):
    errors = []

    def write(k):
        try:
            for i in range(3):
                store.upsert(rows(spark, 100 * k + i))
                if i == 1:
                    store.compact()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and held(store).keys() == {100 * k + i for k in range(3) for i in range(3)}
    assert store.version() == 12


def test_a_change_during_compaction_stays(spark, store, monkeypatch):
    store.upsert(rows(spark, 1))
    write = store._write

    def slow(df, deleted):
        folder = write(df, deleted)
        monkeypatch.setattr(store, "_write", write)
        store.upsert(rows(spark, 2))  # committed before the compacted folder is
        return folder

    monkeypatch.setattr(store, "_write", slow)
    store.compact()
    assert held(store) == {1: "a", 2: "a"}


def plain_scores(batches, fit):
    """Counts by batch, scored one by one with plain medians."""
    past, out, base = collections.defaultdict(list), {}, {}
    for batch in batches:
        for c, h, d, n in sorted(batch, key=lambda r: r[2]):
            p = past[c, h][-30:]
            mid = float(np.median(p)) if p else 0.0
            sd = 1.4826 * float(np.median(np.abs(np.array(p) - mid))) if p else 0.0
            via = "median_mad"
            if (c, h) in base:
                mid, sd, via = *base[c, h], "gp"
            sd = max(sd, 0.5)
            z = (n - mid) / sd
            odd = abs(z) >= 2.576 and len(p) >= 3
            out[c, h, d] = (mid, sd, z, ("spike" if z > 0 else "dip") if odd else "normal", via)
            past[c, h].append(n)
        base = fit([(c, h, n) for (c, h), v in past.items() for n in v[-30:]])
    return out


def test_refits_reach_the_running_detector(spark, tmp_path):
    rng = np.random.RandomState(1)
    day = datetime.date(2024, 1, 1)
    counts = [(c, h, day + datetime.timedelta(i), int(rng.poisson(20 + 5 * (c == "a") + h))) for c in "ab" for h in range(3) for i in range(45)]
    counts[7] = (*counts[7][:3], 400)
    batches = [[r for r in counts if lo <= (r[2] - day).days < hi] for lo, hi in ((0, 2), (2, 34), (34, 45))]
    folder = str(tmp_path / "in")
    os.makedirs(folder)

    def feed(i):
        pd.DataFrame(batches[i], columns=["cluster", "hour", "day", "n"]).astype({"hour": "int32"}).to_parquet(f"{folder}/f{i}.parquet", index=False)

    def fit(rows):
        t = spark.createDataFrame([(c, h, day + datetime.timedelta(i), n) for i, (c, h, n) in enumerate(rows)], refits.COUNTS)
        return {(r.cluster, r.hour): (r.mu, r.sd) for r in rates.refit(t).collect()}

    for i in range(3):  # a run for each file: every start finds state and fits of the last
        feed(i)
        stream = spark.readStream.schema(refits.COUNTS).parquet(folder)
        refits.detect_and_refit(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/scores")).collect()
    want = plain_scores(batches, fit)
    assert len(got) == len(counts) == len(want) and {r.via for r in got} == {"gp", "median_mad"}
    for r in got:
        mid, sd, z, way, via = want[r.cluster, r.hour, r.day]
        assert (r.expected, r.sd, r.z) == pytest.approx((mid, sd, z), abs=1e-6) and (r.direction, r.via) == (way, via)
    state = spark.read.parquet(str(tmp_path / "out/state/batch=2"))
    assert state.count() == 6 * 30 and sorted(os.listdir(tmp_path / "out/state")) == ["batch=1", "batch=2"]
    # a batch that is repeated replaces its own
    new = spark.createDataFrame(batches[2], refits.COUNTS)
    kept = refits._before(spark, str(tmp_path / "out"), "state", 2, refits.COUNTS)
    assert kept.count() == 6 * 30 and refits.last_counts(kept.unionByName(new)).exceptAll(state).count() == 0


def test_compression_ends_after_one_run(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    data = [(i, "e", "k", "ag", "MEASURED", 0.5 + i / 10, float(i), t(i), t(i), None) for i in (1, 2, 3)]
    data += [(7, "e", "k", "ag", "INFERRED", 0.5, 1.0, t(1), t(1), None), (8, "e", "k", "ag", "MEASURED", 0.5, 1.0, t(20), t(20), None)]
    data += [(9, "f", "k", "ag", "MEASURED", 0.5, 1.0, t(1), t(1), None), (10, "e", "k", "ag", "MEASURED", 0.5, 1.0, t(1), t(1), 3)]
    schema = "record long, entity string, kind string, agent string, method string, confidence double, value double, generated_at timestamp_ntz, valid_from timestamp_ntz, invalidated_by long"
    once = memory.compress_old(spark.createDataFrame(data, schema), "2024-01-10 00:00:00", "2024-02-01 00:00:00")
    got = {r.record: r for r in once.collect()}
    assert len(got) == 8
    (s,) = [r for r in got.values() if r.summary]
    assert {k for k, r in got.items() if r.invalidated_by == s.record} == {"1", "2", "3"} and got["10"].invalidated_by == "3"
    assert s.confidence == pytest.approx(0.7) and s.method == "SYNTHESIZED" and '"point_count":3' in s.summary and s.valid_from == t(1)
    again = memory.compress_old(once.drop("summary"), "2024-01-10 00:00:00", "2024-02-01 00:00:00")
    assert again.filter("summary is not null").count() == 0 and again.count() == 8
