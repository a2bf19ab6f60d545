"""Best-fit packing of token ids into sequences of a fixed capacity.

Pieces above a third of the capacity are large: a sequence holds two of them at
most, so they are matched greedily, the longest with the longest that still
fits. Smaller pieces follow by falling length, each in the tightest gap that
holds it, and open sequences of their own when no gap does.

What is packed where depends on the lengths alone, and there are no more of
those than the capacity. So the driver gets a count for each length (2,048 rows
at most, whatever the input), and packs runs: m sequences with the same
contents are one entry, and one step puts all pieces of a length into all gaps
of a size. The result is a table of runs, (length, ranks from .. to) ->
(sequences from .., pieces a sequence, offset). Its size is bounded too: a length
makes two new kinds of sequence at most beside those whose gaps it uses up, and
a sequence has at most 63 different lengths.

Each row finds its rank among the pieces of its length without a global sort:
the task that made it numbers the pieces of each length, the counts of tasks
are summed up by length, and (task, length) joins the sum before it. A length that a
third of all rows share is spread over all tasks.

Token ids: those of the ``tokenizers`` library for the vocabulary file. Texts
whose characters all have a class that never changed, and without a special
token's string, take the equal but faster rank file; all others take the
library itself.

Edge cases: null counts as empty text, which is one piece (the end token); a
text of any length is encoded whole and cut into full pieces, the rest first;
rows that repeat an id are documents of their own, null ids too; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, SAFE
from .common import Scratch, small_batches

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RANK_BITS = 44  # of a rank within its length


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ids:
    """Token ids of texts, as little-endian 32-bit integers."""

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))).search if special else lambda text: None
        self.safe = regex.compile(SAFE).fullmatch

    def __call__(self, text: str) -> np.ndarray:
        if self.safe(text) and not self.special(text):
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_ids: dict[tuple[str, str], Ids] = {}


def ids_of(vocabulary: str, ranks: str) -> Ids:
    """A worker process reads the files once."""
    if (vocabulary, ranks) not in _ids:
        _ids[vocabulary, ranks] = Ids(vocabulary, ranks)
    return _ids[vocabulary, ranks]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: full ones, and what is left before them."""
    first = n % capacity or capacity if n > capacity else n
    return [(0, first), *((i, i + capacity) for i in range(first, n, capacity))]


def make_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, paths: tuple[str, str] | None = None, ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> PIECES (and the ids if asked for): part and nth number a task's pieces of each length."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = ids_of(*(paths or default_paths())), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4", copy=False)
                for i, (a, b) in enumerate(cuts(len(got), capacity)):
                    n = b - a
                    rows.append((doc_id, i, a, n, zlib.crc32(got[a:b]), part, seen[n], got[a:b].astype(np.int32) if ids else None))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[: len(names)], kinds, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * ids)


class Plan:
    """Which sequences hold the pieces of each length, as runs (see the module)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces a sequence, offset
        self.used: Counter = Counter()
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> (first sequence, sequences)
        self.sizes: list[int] = []  # of the gaps that there are, sorted
        left = {n: c for n, c in sorted(counts.items()) if c > 0}
        self._match({n: c for n, c in left.items() if 3 * n > capacity})
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(n, left[n])

    def _open(self, m: int) -> int:
        self.sequences += m
        return self.sequences - m

    def _put(self, n: int, first: int, m: int, each: int, gap: int, pieces: int) -> None:
        """``pieces`` of length n into m sequences from ``first`` on, whose gaps are ``gap``: ``each`` a sequence, fewer in the last one."""
        self.runs.append((n, self.used[n], first, each, self.capacity - gap))
        self.used[n] += pieces

    def _gap(self, size: int, first: int, m: int) -> None:
        if size and m:
            if not self.gaps[size]:
                bisect.insort(self.sizes, size)
            self.gaps[size].append((first, m))

    def _match(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        while lengths:
            a = lengths[-1]
            at = bisect.bisect_right(lengths, self.capacity - a) - 1
            if at < 0:
                m = left.pop(lengths.pop())
                first = self._open(m)
                self._put(a, first, m, 1, self.capacity, m)
                self._gap(self.capacity - a, first, m)
                continue
            b = lengths[at]
            if a == b and left[a] == 1:  # alone of its length: its partner is shorter
                if at:
                    b = lengths[at - 1]
                else:
                    first = self._open(1)
                    self._put(a, first, 1, 1, self.capacity, 1)
                    self._gap(self.capacity - a, first, 1)
                    return
            m = left[a] // 2 if a == b else min(left[a], left[b])
            first = self._open(m)
            if a == b:
                self._put(a, first, m, 2, self.capacity, 2 * m)
            else:
                self._put(a, first, m, 1, self.capacity, m)
                self._put(b, first, m, 1, self.capacity - a, m)
            self._gap(self.capacity - a - b, first, m)
            for n, took in ((a, 2 * m),) if a == b else ((a, m), (b, m)):
                left[n] -= took
                if not left[n]:
                    del left[n]
                    lengths.remove(n)

    def _fit(self, n: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.sizes, n)
            if at == len(self.sizes):
                each = self.capacity // n
                m = -(-count // each)
                gap, first, there = self.capacity, self._open(m), m
            else:
                gap = self.sizes[at]
                first, there = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.sizes[at]
                each = gap // n
            full = min(there, count // each)
            rest = min(count - full * each, each - 1) if full < there else 0
            took = full * each + rest
            self._put(n, first, full + (rest > 0), each, gap, took)
            self._gap(gap - each * n, first, full)
            if rest:
                self._gap(gap - rest * n, first + full, 1)
            self._gap(gap, first + full + (rest > 0), there - full - (rest > 0))
            count -= took

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (length and first rank in one number) and the columns of the runs."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << RANK_BITS) | runs[:, 1], runs[:, 1], runs[:, 2], runs[:, 3], runs[:, 4]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(length, part, nth, ..), a written table, with sequence_id and offset instead of part and nth."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    plan = pieces.sparkSession.sparkContext.broadcast(Plan(by_length, capacity).arrays())

    @F.pandas_udf("sequence_id long, offset long")
    def at(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first_rank, first, each, offset = plan.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(keys, (n << RANK_BITS) | r, "right") - 1
        k = r - first_rank[i]
        return pd.DataFrame({"sequence_id": first[i] + k // each[i], "offset": offset[i] + k % each[i] * n})

    rest = [c for c in pieces.columns if c not in ("part", "nth")]
    placed = pieces.join(starts, ["part", "length"]).withColumn("at", at("length", F.col("before") + F.col("nth")))
    return placed.select(*rest, "at.sequence_id", "at.offset")


def pack(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY, ids: bool = False, **settings) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(scratch.save(make_pieces(docs, capacity, ids=ids, **settings), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """pack(.., ids=True) -> sequence_id, n_pieces, ids: one row for each sequence, which holds ``capacity`` ids at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))
