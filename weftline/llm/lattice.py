"""Language-model scores from a subword lattice.

A word, with a mark for its start, has many segmentations into the pieces of
an existing vocabulary. The vocabulary's own scores give each piece a first
weight; expectation steps over the training words' lattices (``steps``, 0 for
none) then fit the weights to the corpus. A text's probability is the product of its words' and
of an end; a word's sums over all its segmentations, by a forward recursion in
log space. Pieces and the end together have probability 1. Byte pieces make
every text possible.

Counts of training words come from bounded memtables in each task and one
combined shuffle. Words that are frequent enough (HEAD_WORDS at most, by a
threshold on the count) are broadcast with count and probability; the counts of
all others are joined, once for each text and distinct word.

A word is known by its 64-bit hash: two words of one hash would share a count
(with 10 million different words about once in 400,000 corpora).

Edge cases: null counts as empty text (an end alone); a text of any length is
whole, a very long word too; repeated ids give a row each; with no training
text N and V are 0 and the weights stay the vocabulary's; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import Scratch, crc_mod, small_batches

FOLDS, HELD_OUT = 7, 2
MEMTABLE_WORDS, HEAD_WORDS = 300_000, 200_000
STEPS, PRIOR = 3, 1.0  # expectation steps; what the vocabulary's own weights count for, in pieces each
LONG_WORD, CHUNK = 80, 20_000
NEVER = -1e30


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """(bytes, log weight) of each piece that stands for text; a word's start is a space.

    The file's scores are ranks (0, -1, ...); a piece's first weight falls with
    its rank. Byte pieces get the last rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, rank = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            pieces.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            rank.append(float(sp.get_piece_size()))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append(sp.id_to_piece(i).replace("▁", " ").encode())
            rank.append(-sp.get_score(i))
    weight = -np.log(np.array(rank) + 10.0)
    return pieces, weight - np.logaddexp.reduce(weight)


class Lattice:
    """Trie of the pieces and the recursions over words (bytes that begin with a space)."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        step: dict[int, int] = {}
        ends: list[list[int]] = [[], []]  # node 0 is dead, 1 the root
        for i, x in enumerate(pieces):
            at = 1
            for b in x:
                key = at << 8 | b
                if key not in step:
                    step[key] = len(ends)
                    ends.append([])
                at = step[key]
            ends[at].append(i)
        self.next = np.zeros((len(ends), 256), np.int32)
        for key, to in step.items():
            self.next[key >> 8, key & 255] = to
        # a byte piece can spell the same as a letter: a node has up to two pieces
        if max(map(len, ends)) > 2:
            raise ValueError("more than two pieces of the vocabulary spell the same")
        self.longest = max(map(len, pieces))
        self.slots = np.full((len(ends), 2), len(pieces), np.int32)
        for at, ids in enumerate(ends):
            self.slots[at, : len(ids)] = ids[:2]

    def node_weights(self, weight: np.ndarray) -> np.ndarray:
        both = np.append(weight, NEVER)[self.slots]
        return np.logaddexp(both[:, 0], both[:, 1])

    def _arcs(self, letters: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, nodes) of all pieces in words of one length."""
        out, length = [], letters.shape[1]
        for i in range(length):
            rows, node = np.arange(len(letters)), np.ones(len(letters), np.int32)
            for k in range(i, length):
                node = self.next[node, letters[rows, k]]
                alive = node > 0
                if not alive.all():
                    rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                full = self.slots[node, 0] < len(self.pieces)
                out.append((i, k + 1, rows[full], node[full]))
        return out

    def _forward(self, arcs, n: int, length: int, nw: np.ndarray) -> np.ndarray:
        alpha = np.full((length + 1, n), NEVER)
        alpha[0] = 0
        for i, k, rows, node in arcs:
            alpha[k, rows] = np.logaddexp(alpha[k, rows], alpha[i, rows] + nw[node])
        return alpha

    def _spans(self, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, node) of all pieces in one word of any length, by end: all starts walk the trie together."""
        letters = np.frombuffer(x, np.uint8)
        at, node = np.arange(len(x)), np.ones(len(x), np.int32)
        found = []
        for k in range(self.longest):
            at, node = at[at + k < len(x)], node[at + k < len(x)]
            node = self.next[node, letters[at + k]]
            at, node = at[node > 0], node[node > 0]
            full = self.slots[node, 0] < len(self.pieces)
            found.append((at[full], at[full] + k + 1, node[full]))
        start, end, node = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], node[order]

    @staticmethod
    def _alpha(n: int, start: np.ndarray, end: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Forward values of one word's positions; spans are ordered by end."""
        alpha = np.full(n + 1, NEVER)
        alpha[0] = 0.0
        cuts = np.searchsorted(end, np.arange(n + 2))
        for k in range(1, n + 1):
            lo, hi = cuts[k], cuts[k + 1]
            if hi > lo:
                alpha[k] = np.logaddexp.reduce(alpha[start[lo:hi]] + w[lo:hi])
        return alpha

    def word(self, x: bytes, nw: np.ndarray) -> float:
        """Log probability of one word, any length."""
        start, end, node = self._spans(x)
        return float(self._alpha(len(x), start, end, nw[node])[-1])

    def _word_expected(self, x: bytes, count: float, nw: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one word, any length."""
        n, (start, end, node) = len(x), self._spans(x)
        alpha = self._alpha(n, start, end, nw[node])
        # backward values are forward ones of the word from its end
        order = np.argsort(n - start, kind="stable")
        beta = self._alpha(n, n - end[order], n - start[order], nw[node[order]])[::-1]
        rest, total = alpha[start] + beta[end] - alpha[-1], np.zeros(len(self.pieces) + 1)
        for j in (0, 1):
            ids = self.slots[node, j]
            total += np.bincount(ids, np.exp(np.minimum(rest + wide[ids], 0)) * count, len(total))
        return total

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, letters with the start's space) by length, in bounded chunks; long words left out."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            if not len(group) or sizes[group[0]] > LONG_WORD:
                continue
            chunk = max(1, CHUNK * 8 // (int(sizes[group[0]]) + 1))
            for at in range(0, len(group), chunk):
                some = group[at : at + chunk]
                raw = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), -1)
                yield some, np.concatenate([np.full((len(some), 1), 32, np.uint8), raw], axis=1)

    def log_probabilities(self, words: list[bytes], nw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for some, letters in self._groups(words):
            out[some] = self._forward(self._arcs(letters), len(some), letters.shape[1], nw)[-1]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.word(b" " + w, nw)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, long ones one by one."""
        total = np.zeros(len(self.pieces) + 1)
        nw = self.node_weights(weight)
        wide = np.append(weight, NEVER)
        for w, c in zip(words, counts, strict=True):
            if len(w) > LONG_WORD:
                total += self._word_expected(b" " + w, c, nw, wide)
        for some, letters in self._groups(words):
            arcs = self._arcs(letters)
            n, length = letters.shape
            alpha = self._forward(arcs, n, length, nw)
            beta = np.full((length + 1, n), NEVER)
            beta[length] = 0
            for i, k, rows, node in reversed(arcs):
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[k, rows] + nw[node])
            for i, k, rows, node in arcs:
                rest = alpha[i, rows] + beta[k, rows] - alpha[-1, rows]
                for j in (0, 1):
                    ids = self.slots[node, j]
                    use = np.exp(np.minimum(rest + wide[ids], 0)) * counts[some][rows]
                    total += np.bincount(ids, use, len(total))
        return total[:-1]


_lattices: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    """One for each process; the vocabulary's path must be readable there."""
    if path not in _lattices:
        _lattices[path] = Lattice(load_pieces(path)[0])
    return _lattices[path]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (h, word, c) from bounded memtables."""
    keys, counts, refs, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array([words[i] for i in refs], pa.binary()), pa.array(counts)],
            names=["h", "word", "c"],
        )

    for batch in batches:
        with np.errstate(over="ignore"):
            for _, raw, offs in textvec.pieces(batch.column(0)):
                h, start, end, _ = textvec.words(raw, offs)
                if not len(h):
                    continue
                low = textvec.LOWER[raw].tobytes()
                some, at, n = np.unique(h, return_index=True, return_counts=True)
                where = np.searchsorted(keys, some)
                old = np.zeros(len(some), bool)
                if len(keys):
                    old = keys[np.minimum(where, len(keys) - 1)] == some
                counts[where[old]] += n[old]
                new = ~old
                fresh = at[new]
                refs = np.insert(refs, where[new], len(words) + np.arange(len(fresh)))
                words += [low[s:e] for s, e in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
                keys, counts = np.insert(keys, where[new], some[new]), np.insert(counts, where[new], n[new])
                if len(keys) >= MEMTABLE_WORDS:
                    yield flush()
                    keys, counts, refs, words = keys[:0], counts[:0], refs[:0], []
    if len(keys):
        yield flush()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Batches of words joined to some tens of thousands: the recursions run over many words at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class LatticeModel:
    """Counts of the training words (h, word, c) and the fitted weights."""

    def __init__(self, docs: DataFrame, scratch: Scratch, path: str | None = None, steps: int = STEPS):
        """docs(doc_id, text): learns from those outside the held-out fold."""
        spark = self.spark = docs.sparkSession
        self.scratch, self.path = scratch, path or default_path()
        small_batches(spark)
        train = docs.filter(crc_mod("doc_id", FOLDS) != HELD_OUT).select("text")
        self.ends = train.count()
        counted = train.mapInArrow(_count, "h long, word binary, c long")
        self.counts = scratch.save(counted.groupBy("h", "word").agg(F.sum("c").alias("c")), "counts")
        total = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n = int(total[0]) + self.ends
        self.v = int(total[1]) + (1 if self.ends else 0)
        _, first = load_pieces(self.path)
        self.weight, self.end = self._normal(np.exp(first) * PRIOR * len(first), self.ends)
        for _ in range(steps if self.n else 0):
            self.weight, self.end = self._normal(
                self._expected() + PRIOR * len(first) * np.exp(first), self.ends
            )

    @staticmethod
    def _normal(uses: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
        total = uses.sum() + ends + 1
        return np.log(uses / total), float(np.log((ends + 1) / total))

    def _expected(self) -> np.ndarray:
        path, weight = self.path, self.spark.sparkContext.broadcast(self.weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in _gathered(batches):
                got = _lattice(path).expected(b.column(0).to_pylist(), b.column(1).to_numpy(), weight.value)
                total = got if total is None else total + got
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        uses = self.counts.select("word", "c").mapInArrow(run, "piece long, uses double")
        got = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        out = np.zeros(len(self.weight))
        out[got["piece"].to_numpy(np.int64)] = got["uses"].to_numpy()
        return out

    def head(self) -> pd.DataFrame:
        """h, c and log probability of the most frequent words, HEAD_WORDS at most."""
        hist = self.counts.groupBy(F.least("c", F.lit(5000)).alias("c")).agg(F.count("*").alias("n")).toPandas()
        hist = hist.sort_values("c", ascending=False)
        fits = hist["c"][hist["n"].cumsum() <= HEAD_WORDS]
        least = int(fits.min()) if len(fits) else 1 << 62
        path, weight = self.path, self.spark.sparkContext.broadcast(self.weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nw = None
            for b in _gathered(batches):
                nw = _lattice(path).node_weights(weight.value) if nw is None else nw
                lp = _lattice(path).log_probabilities(b.column(1).to_pylist(), nw)
                cols = [b.column(0).combine_chunks(), b.column(2).combine_chunks(), pa.array(lp)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "c", "lp"])

        rows = self.counts.filter(F.col("c") >= least).select("h", "word", "c")
        out = rows.mapInArrow(run, "h long, c long, lp double").toPandas()
        out["h"] = out["h"].to_numpy(np.int64).view(np.uint64)
        return out.sort_values("h")

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text)."""
        head = self.head()
        shared = self.spark.sparkContext.broadcast(
            {
                "h": head["h"].to_numpy(np.uint64), "c": head["c"].to_numpy(np.int64), "lp": head["lp"].to_numpy(np.float64),
                "weight": self.weight, "end": self.end, "ends": self.ends,
            }
        )
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = shared.value
            hh, lattice = s["h"], _lattice(path)
            nw, seen, hlp = lattice.node_weights(s["weight"]), np.log10(s["c"] + 1.0), s["lp"]
            for batch in batches:
                cols: list[list] = [[], [], [], []]
                tails_h, tails_n, sizes = [], [], []
                with np.errstate(over="ignore"):
                    for _, raw, offs in textvec.pieces(batch.column(1)):
                        h, start, end, first = textvec.words(raw, offs)
                        at = np.minimum(np.searchsorted(hh, h), max(len(hh) - 1, 0))
                        hit = hh[at] == h if len(hh) else np.zeros(len(h), bool)
                        lp, base = np.zeros(len(h)), np.zeros(len(h))
                        lp[hit], base[hit] = hlp[at[hit]], seen[at[hit]]
                        miss = np.flatnonzero(~hit)
                        if len(miss):
                            low = textvec.LOWER[raw].tobytes()
                            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
                            pick = miss[one]
                            spelled = [low[a:b] for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
                            lp[miss] = lattice.log_probabilities(spelled, nw)[back]
                        run_lp, run_base, run_hit = (
                            np.concatenate([[0], np.cumsum(x)]) for x in (lp, base, hit.astype(np.int64))
                        )
                        for x, run_x in zip(cols[1:], (run_hit, run_base, run_lp), strict=True):
                            x.append(run_x[first[1:]] - run_x[first[:-1]])
                        cols[0].append(np.diff(first) + 1)
                        cut = np.searchsorted(miss, first)
                        for i in range(len(offs) - 1):
                            u, n = np.unique(h[miss[cut[i] : cut[i + 1]]], return_counts=True)
                            tails_h.append(u)
                            tails_n.append(n)
                            sizes.append(len(u))
                offs = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat_h = np.concatenate([*tails_h, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                flat_n = np.concatenate([*tails_n, np.zeros(0, np.int64)]).astype(np.int64)
                n, known, base, lp = (np.concatenate([*c, np.zeros(0)]) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(2), pa.array(n.astype(np.int64)),
                        pa.array(known.astype(np.int64)), pa.array(base), pa.array(lp),
                        pa.ListArray.from_arrays(offs, pa.array(flat_h)), pa.ListArray.from_arrays(offs, pa.array(flat_n)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "lp", "th", "tn"],
                )

        rows = docs.select(
            F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out")
        ).mapInArrow(
            run, "doc_id long, held_out boolean, n_tokens long, known long, base double, lp double, th array<long>, tn array<long>"
        )
        rows = self.scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
        tail = rows.select("row", F.explode(F.arrays_zip("th", "tn")).alias("t")).select("row", "t.th", "t.tn")
        found = tail.join(self.counts.select(F.col("h").alias("th"), "c"), "th")
        sums = found.groupBy("row").agg(
            F.sum("tn").alias("more_known"), F.sum(F.col("tn") * F.log10(F.col("c") + 1)).alias("more_base")
        )
        out = rows.drop("th", "tn").join(sums, "row", "left")
        zero = F.lit(0)
        log_all = float(np.log10(self.n + self.v + 1))
        end_base = float(np.log10(self.ends + 1))
        return out.select(
            "doc_id", "held_out", "n_tokens",
            (F.col("known") + F.coalesce("more_known", zero) + (1 if self.ends else 0)).cast("long").alias("n_known"),
            F.lit(self.n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end_base - F.col("n_tokens") * log_all).alias("base_score"),
            ((F.col("lp") + self.end) / float(np.log(10))).alias("score"),
        )


def score_documents(docs: DataFrame, scratch: Scratch, path: str | None = None, steps: int = STEPS) -> DataFrame:
    """Fit on the training fold of docs and score all of docs."""
    return LatticeModel(docs, scratch, path, steps).score(docs)
