"""Near duplicates by an LSH forest over MinHash signatures, with links confirmed on full sets.

A row's set holds the hashes of its text's distinct 5-word shingles. Rows with
equal sets are one class, and classes are the vertices; rows are told apart by
a key of their own, so an id that comes with two texts has two vertices. Each
class has a pool of minimum hashes; a tree of the forest is an order of some of
them, and the classes sorted by (tree, values) lie beside those that share the
longest prefix with them. Candidates are

* the smallest class of a region, for each depth of the region from MIN_DEPTH
  on (a dense region has deeper ones inside, a sparse one hasn't);
* the neighbours in sorted order that share MIN_DEPTH values or more;
* what these leave open: neighbours are all pairs of a region of up to
  NEIGHBOURS + 1 classes; the members of larger ones are joined on the rarest
  shingles of their sets, over all pairs that are not in one group yet.

All candidates are confirmed on full sets (100 * both >= 75 * either). Groups
are labels first: a class takes the smallest leader that it is linked to, and
that one's label again, so most pairs of a dense region have one label and need
no check. What is linked across labels ends in one component at last.
Trees begin with MIN_DEPTH values of their own (POOL = TREES * MIN_DEPTH), so a
pair at the similarity limit shares a region in at least one tree with probability
1 - (1 - 0.75^3)^TREES, about 1 - 2e-6, and a pair that shares a region ends in one component: leaders only
settle most pairs early, the join on rare shingles is exact for the rest.

Sets are ordered by the frequency of a shingle's bucket, the same order for
all, so that similar sets meet in the first quarter of the larger and the first
seventh of the smaller one. A long passage that many texts share is frequent
and comes last: only texts that it makes similar by itself meet in it. The
buckets are of fixed number and change the cost of the join, never its result.

Nothing is grouped by region: the sorted order is cut into even ranges by
sampling, so a region with a third of all classes spreads over many tasks; what
crosses a cut gets its leader in a second step with two regions from each range,
and its members take part in the join on rare shingles, whatever the region's size.

Edge cases: null counts as empty text; texts without words have no shingles
and stay alone; 1 to 4 words are one shingle; a row with a null id has links
like any other, its component's smallest id (null if there is none) and kept
false; rows that repeat an id and a text share a result; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import Bloom, Scratch, keyed, small_batches
from .components import components

SHINGLE = 5
POOL, TREES, DEPTH, MIN_DEPTH = 72, 24, 6, 3
PERCENT = 75
NEIGHBOURS = 3
JUMPS = 2
ROWS_A_RANGE = 250_000
BUCKETS = 1 << 19

_rng = np.random.default_rng(75)
_FACTORS = _rng.integers(1, 1 << 63, POOL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: No two trees share one of their first MIN_DEPTH values: regions of different trees are independent.
_FIRST = _rng.permutation(POOL).reshape(TREES, MIN_DEPTH)
_ORDERS = np.array([[*f, *_rng.permutation(np.setdiff1d(np.arange(POOL), f))[: DEPTH - MIN_DEPTH]] for f in _FIRST])
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)]


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets by text) from the word hashes of several texts."""
    counts = np.diff(first)
    full = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    offs = np.zeros(len(first), np.int64)
    np.cumsum(full, out=offs[1:])
    out = np.zeros(offs[-1], np.uint64)
    n = len(hashes)
    if n >= SHINGLE:
        m = n - SHINGLE + 1
        rolled = np.zeros(m, np.uint64)
        for j in range(SHINGLE):
            rolled += hashes[j : j + m] * _STEP[j]
        rolled = textvec.mix(rolled)
        text = np.repeat(np.arange(len(counts)), counts)[:m]
        whole = np.arange(m) + SHINGLE <= first[text + 1]
        at = np.arange(m)[whole]
        out[offs[text[whole]] + at - first[text[whole]]] = rolled[whole]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        h = np.uint64(counts[i])
        for w in hashes[first[i] : first[i + 1]]:
            h = textvec.mix(np.array([h * _STEP[0] + w]))[0]
        out[offs[i]] = h
    return out, offs


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, offsets) by piece of a text column."""
    with np.errstate(over="ignore"):
        for at, raw, offs in textvec.pieces(column):
            h, _, _, first = textvec.words(raw, offs)
            sh, so = shingles(h, first)
            yield at, sh, so


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, text -> doc_id, row, n_shingles, set_key, sig."""
    for batch in batches:
        n, key, sig = [], [], []
        for _, sh, so in _sets(batch.column(2)):
            some = np.flatnonzero(np.diff(so) > 0)
            low = np.zeros((POOL, len(so) - 1), ">u4")
            if len(some):
                starts = so[:-1][some]
                for k in range(POOL):
                    low[k, some] = np.minimum.reduceat(sh * _FACTORS[k], starts) >> np.uint64(32)
            low = np.ascontiguousarray(low.T)
            for i in range(len(so) - 1):
                one = np.unique(sh[so[i] : so[i + 1]])
                n.append(len(one))
                key.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None)
                sig.append(low[i].tobytes() if len(one) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
            names=["doc_id", "row", "n_shingles", "set_key", "sig"],
        )


def _fixed(rows: np.ndarray) -> pa.Array:
    """A uint8 matrix as a binary column."""
    n, width = rows.shape
    offs = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    _, offs, data = column.buffers()
    start = np.frombuffer(offs, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + len(column) * width].reshape(-1, width)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n, sig -> a row for each tree: key (tree, then DEPTH values), rep, n."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column(2), POOL * 4).reshape(-1, POOL, 4)
        m = len(sig)
        out = np.empty((TREES, m, 1 + DEPTH * 4), np.uint8)
        for t in range(TREES):
            out[t, :, 0] = t
            out[t, :, 1:] = sig[:, _ORDERS[t]].reshape(m, -1)
        rep, n = (np.tile(batch.column(i).to_numpy(zero_copy_only=False), TREES) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [_fixed(out.reshape(TREES * m, -1)), pa.array(rep, pa.int64()), pa.array(n, pa.int64())],
            names=["key", "rep", "n"],
        )


PAIR = "kind int, a long, b long, region binary, n long, part int"
LEADER, NEIGHBOUR, CUT, DENSE = 0, 1, 2, 3


def _close(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of the forest -> candidate pairs, members of large regions, and those of its first and last one."""
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    width = 1 + DEPTH * 4
    keys = np.concatenate([_matrix(b.column(0), width) for b in got])
    rep = np.concatenate([b.column(1).to_numpy() for b in got])
    n = np.concatenate([b.column(2).to_numpy() for b in got])
    m = len(rep)
    same = np.zeros((m, DEPTH + 1), bool)
    same[1:, 0] = keys[1:, 0] == keys[:-1, 0]
    values = np.ascontiguousarray(keys[:, 1:]).view(">u4").reshape(m, DEPTH)
    same[1:, 1:] = values[1:] == values[:-1]
    shared = np.cumprod(same, axis=1).sum(axis=1) - 1  # values shared with the row before; -1 in another tree
    found = []
    for depth in range(MIN_DEPTH, DEPTH + 1):
        starts = np.flatnonzero(shared < depth)
        size = np.diff(np.append(starts, m))
        if not (size > 1).any():
            break
        lead = np.minimum.reduceat(rep, starts)
        who = np.repeat(lead, size)
        order = np.repeat(_argmin(rep, starts, lead, size), size)
        ok = (who != rep) & _close(n, n[order])
        found.append((LEADER, who[ok], rep[ok]))
    starts = np.flatnonzero(shared < MIN_DEPTH)
    ends = np.append(starts[1:], m)
    mates = np.repeat(ends - starts, ends - starts)
    reach = np.full(m, DEPTH)
    for j in range(1, NEIGHBOURS + 1):
        reach = np.minimum(reach[:-1], shared[j:])  # values that rows i and i + j share
        i = np.flatnonzero(reach >= MIN_DEPTH)  # all pairs of a small region
        i = i[_close(n[i], n[i + j]) & (rep[i] != rep[i + j])]
        found.append((NEIGHBOUR, np.minimum(rep[i], rep[i + j]), np.maximum(rep[i], rep[i + j])))
    a, b = (np.concatenate([f[k] for f in found]) for k in (1, 2))
    kind = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
    order = np.lexsort((kind, b, a))
    a, b, kind = a[order], b[order], kind[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    part = TaskContext.get().partitionId()
    yield _pairs(kind[new], a[new], b[new], None, None, part)
    dense = np.unique(rep[mates > NEIGHBOURS + 1])
    yield _pairs(np.full(len(dense), DENSE), dense, dense, None, None, part)
    for k in {0, len(starts) - 1}:
        s, e = starts[k], ends[k]
        prefix = keys[s, : 1 + MIN_DEPTH * 4].tobytes()
        yield _pairs(np.full(e - s, CUT), rep[s:e], rep[s:e], [prefix] * (e - s), n[s:e], part)


def _argmin(rep: np.ndarray, starts: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Row of each region's smallest id."""
    hit = np.flatnonzero(rep == np.repeat(lead, size))
    region = np.repeat(np.arange(len(starts)), size)[hit]
    first = np.ones(len(hit), bool)
    first[1:] = region[1:] != region[:-1]
    return hit[first]


def _pairs(kind, a, b, region, n, part: int) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
            pa.array(region, pa.binary()) if region else pa.nulls(m, pa.binary()),
            pa.array(n, pa.int64()) if n is not None else pa.nulls(m, pa.int64()),
            pa.array(np.full(m, part), pa.int32()),
        ],
        names=["kind", "a", "b", "region", "n", "part"],
    )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, sh, so in _sets(batch.column(1)):
            out += [np.unique(sh[so[i] : so[i + 1]]).tobytes() for i in range(len(so) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "items"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, items of a, items of b -> the pairs that are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def candidates(reps: DataFrame, classes: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """reps(rep, n, sig), so many classes. Gives distinct (a, b, kind) with a < b, kind 0 if a region's leader made it, and (v)
    for members of regions whose neighbours in a range aren't all pairs."""
    spark = reps.sparkSession
    rows = classes * TREES
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_RANGE + 1)
    forest = reps.select("rep", "n", "sig").mapInArrow(_plant, "key binary, rep long, n long")
    ordered = forest.repartitionByRange(ranges, "key", "rep").sortWithinPartitions("key", "rep")
    raw = scratch.save(ordered.mapInArrow(_neighbours, PAIR), "raw_pairs")
    cut = raw.filter(F.col("kind") == CUT)
    # two regions of each range at most; the join is planned by its size
    crossing = cut.groupBy("region").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.min(F.struct("a", "n")).alias("lead")
    ).filter("lo < hi").select("region", "lead")
    led = cut.join(crossing, "region").select(
        F.lit(LEADER).alias("kind"), F.col("lead.a").alias("a"), "b", F.col("lead.n").alias("n1"), "n"
    ).filter(f"a <> b and 100 * least(n, n1) >= {PERCENT} * greatest(n, n1)").select("kind", "a", "b")
    pairs = raw.filter(F.col("kind") < CUT).select("kind", "a", "b").unionByName(led)
    # neighbours on both sides of a cut never meet in a range
    apart = cut.join(crossing, "region").select(F.col("b").alias("v"))
    dense = raw.filter(F.col("kind") == DENSE).select(F.col("a").alias("v")).unionByName(apart).distinct()
    return pairs.groupBy("a", "b").agg(F.min("kind").alias("kind")), dense


def _ends(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Sets without most of those that pairs, a written table, don't name: sets are long and are shuffled by id."""
    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    return sets.filter(Bloom(scratch.save(ids, "ends"), "id").flag("id"))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = (sets.select(F.col("id").alias(k), F.col("items").alias(f"s{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_confirm, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """(v, c): for each class with a smaller partner the smallest one's label; a label is linked to the class over partners."""
    low = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c"))
    for _ in range(JUMPS):
        low = low.join(low.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select(
            "v", F.coalesce("up", "c").alias("c"))
    return low


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the labels of both sides, ca and cb, where they differ."""
    for k in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("v").alias(k), F.col("c").alias(f"c{k}")), k, "left")
        pairs = pairs.withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    return pairs.filter("ca <> cb")


def _bucket(items: np.ndarray) -> np.ndarray:
    return (textvec.mix(items) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _items(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    return (np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, items -> bucket, n: sets' shingles by bucket, for a task."""
    total = np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            for x in _items(batch, 1):
                np.add.at(total, _bucket(x), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def _rarest(frequency):
    """id, items, c -> h, id, c, n, at: the first shingles of each set by frequency; at is the place in that order.

    100 * both >= PERCENT * either means (100 + PERCENT) * both >= PERCENT * (sum of sizes), so a set of n has
    least = ceil(PERCENT * n / 100) of its shingles in common with a partner at least, and the first common one is
    among its first n - least + 1. A bucket that counts one shingle is in no other set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                h, at, size = [], [], []
                for x in _items(batch, 1):
                    often = frequency.value[_bucket(x)]
                    least = -(-PERCENT * len(x) // 100)
                    order = np.lexsort((x, often))[: len(x) - least + 1]
                    some = np.flatnonzero(often[order] > 1)
                    h.append(x[order[some]])
                    at.append(some)
                    size.append(len(x))
                rows = [len(x) for x in h]
                if not sum(rows):
                    continue
                each = pa.array(np.repeat(np.arange(len(rows)), rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(h).view(np.int64)), batch.column(0).take(each), batch.column(2).take(each),
                        pa.array(np.repeat(np.array(size, np.int64), rows)), pa.array(np.concatenate(at).astype(np.int64)),
                    ],
                    names=["h", "id", "c", "n", "at"],
                )

    return run


def _rare_pairs(dense: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, ca, cb) of dense(v) with two labels that can be similar: none that is similar is left out."""
    spark = sets.sparkSession
    mine = sets.join(dense.select(F.col("v").alias("id")), "id", "left_semi")
    counts = mine.mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(
        F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    frequency = np.zeros(BUCKETS, np.uint32)
    frequency[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    del counts
    classed = mine.join(labels.withColumnRenamed("v", "id"), "id", "left").select("id", "items", F.coalesce("c", "id").alias("c"))
    shared = spark.sparkContext.broadcast(frequency)
    rare = scratch.save(classed.mapInArrow(_rarest(shared), "h long, id long, c long, n long, at long"), "rare")
    shared.destroy()
    # both >= PERCENT / (100 + PERCENT) * (sum of sizes) >= 2 * PERCENT / (100 + PERCENT) * (size of the smaller set): so early
    # does the smaller set meet a partner, and a shingle that comes so early in no set pairs nobody
    early = f"{100 + PERCENT} * (n - at) >= {2 * PERCENT} * n"
    rare = rare.withColumn("early", F.expr(early))
    sizes = rare.groupBy("h", "c").agg(F.count("*").alias("k"), F.max("early").alias("early"))
    mixed = sizes.groupBy("h").agg(
        F.max(F.struct("k", "c"))["c"].alias("top"), F.count("*").alias("classes"), F.max("early").alias("early")
    ).filter("classes > 1 and early").select("h", "top")
    met = scratch.save(rare.join(mixed, "h"), "met")
    side = lambda k: met.select("h", "top", *[F.col(c).alias(f"{c}{k}") for c in ("id", "c", "n", "at", "early")])
    low, high = side(1).filter("early1"), side(2).withColumnRenamed("top", "top2")
    # one of two classes isn't the shingle's largest, which so is never paired with itself
    both = low.filter("c1 <> top").join(high, "h").unionByName(
        low.filter("c1 = top").join(high.filter("c2 <> top2"), "h")
    ).filter(f"c1 <> c2 and (n1 < n2 or n1 = n2 and id1 < id2) and 100 * n1 >= {PERCENT} * n2")
    # the first common shingle: all others come after it on both sides
    both = both.filter(f"{100 + PERCENT} * least(n1 - at1, n2 - at2) >= {PERCENT} * (n1 + n2)")
    return both.select(
        F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"),
        F.when(F.col("id1") < F.col("id2"), F.col("c1")).otherwise(F.col("c2")).alias("ca"),
        F.when(F.col("id1") < F.col("id2"), F.col("c2")).otherwise(F.col("c1")).alias("cb"),
    ).distinct()


def near_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc_id, text, row), rows of their own keys -> doc_id, row, n_shingles, c, component_id, n_links.

    c numbers the component (null without shingles), component_id is its smallest
    id. n_links counts the confirmed links of the row's class.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "row", "text")
    signed = scratch.save(
        texts.mapInArrow(
            _signatures, f"doc_id long, row {dict(texts.dtypes)['row']}, n_shingles long, set_key binary, sig binary"),
        "signed",
    )
    reps = signed.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc"), F.min("row").alias("row"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig")
    )
    reps = scratch.save(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # numbers are fixed where they are written
    n = reps.count()  # pairs and classes are of this order; confirming links reads whole sets and keeps its own partitions
    pairs, dense = candidates(reps, n, scratch)
    pairs, dense = scratch.save(pairs, "pairs", n), scratch.save(dense, "dense", n)
    scratch.drop("raw_pairs")
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(
        dense.select(F.col("v").alias("rep"))).distinct()
    wanted = scratch.save(reps.select("rep", "row").join(ids, "rep"), "wanted", n)
    # merged where a broadcast would do too: else filter and sets share a task, with a Python worker each that stays in memory
    near = texts.filter(Bloom(wanted, "row").flag("row")).join(wanted.hint("merge"), "row").select("rep", "text")
    sets = scratch.save(near.mapInArrow(_full_sets, "id long, items binary"), "sets")
    # nearly all of the sets have a leader or are one
    links = scratch.save(_verify(pairs.filter(F.col("kind") == LEADER), sets), "links0")
    labels = scratch.save(_labels(links), "labels", n)
    open_ = scratch.save(_labelled(pairs.filter(F.col("kind") == NEIGHBOUR), labels), "open", n)
    more = scratch.save(_verify(open_, scratch.save(_ends(open_, sets, scratch), "sets1")), "links1")
    scratch.drop("sets1")
    edges = links.unionByName(more)
    merged = scratch.save(components(_between(edges, labels), scratch, "c1_"), "merged1", n)
    labels = scratch.save(_renamed(labels, merged), "labels1", n)
    rest = scratch.save(_rare_pairs(dense, labels, sets, scratch), "rest")  # takes every open pair there is
    last = scratch.save(_verify(rest, scratch.save(_ends(rest, sets, scratch), "sets2")), "links2")
    scratch.drop("rare", "met", "rest", "sets", "sets2", "ends", "pairs", "open")
    if not last.isEmpty():
        edges = edges.unionByName(last)
        merged = scratch.save(components(_between(last, labels), scratch, "c2_"), "merged2", n)
        labels = scratch.save(_renamed(labels, merged), "labels2", n)
    degree = edges.distinct().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = reps.select("set_key", "rep", "doc").join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(
        degree, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    least = named.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = scratch.save(named.join(least, "c").select("set_key", "c", "component_id", "n_links"), "named", n)
    return signed.select("doc_id", "row", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "row", "n_shingles", "c", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between labels, as (a, b) with a < b."""
    across = _labelled(edges.select("a", "b"), labels)
    return across.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def _renamed(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after merged(v, c): label v is now c."""
    up = merged.select(F.col("v").alias("c"), F.col("c").alias("up"))
    out = labels.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
    return out.unionByName(merged.select("v", "c")).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) for every row of docs(doc_id, text)."""
    rows, key = keyed(docs, scratch)
    found = near_classes(rows.select("doc_id", "text", F.col(key).alias("row")), scratch)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "n_links")


def later_members(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key) of the rows of docs(doc_id, text, key) to drop: all of a component but one.

    The row with the smallest id stays (of null ids, and of rows that repeat it, the first by key).
    """
    rows = docs.select("doc_id", "text", F.col(key).alias("row"))
    found = scratch.save(near_classes(rows, scratch).filter("c is not null").select("doc_id", "row", "c"), "members")
    first = found.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))["row"].alias("row"))
    return found.join(first, "row", "left_anti").select(F.col("row").alias(key))
