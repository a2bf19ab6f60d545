r"""Phrases of two to five words that occur more often than their parts suggest, by language.

Candidates come from sketches. A sketch is ``ROWS`` rows of cells; each task
counts into its own, blocks of cells are summed across tasks, and all that is
kept is a bit for each cell: can a phrase of this cell reach the threshold? As
cells only overcount, no phrase that reaches it is lost. Three sketches follow each
other, and each counts only what the one before admits: words, then pairs of
admitted words, then phrases of three to five words whose pairs are all admitted.
Tasks cut their counts at the threshold before they pass them on, which leaves
the bits as they are and makes a cell one or two bytes.

A further scan collects the different phrases that the last bits admit, with how
often each occurs; those whose sums reach the threshold, together with their first
and last words, are the candidates. They are dealt by language into shards of
``shard`` phrases at most; each shard is broadcast (its size is bounded by that),
compiled into an automaton for each language, and counted over the texts of its
languages. In texts and patterns each word stands between single spaces and a line
feed divides pieces, so that the automaton's overlapping matches are exactly the
occurrences of whole words within pieces. Sums over shards and tasks are exact
counts; thresholds and scores apply to those alone.

Memory: a sketch has at most 2^MAX_BITS cells a row whatever the input. Where a
cell's share of the phrases comes near the threshold (beyond some 4 GB of text
for a threshold of 100; a threshold that grows with the corpus keeps its
distance), more phrases are collected than need be; their sums drop them before
any shard is made, so they cost rows of one shuffle, never results.

Edge cases: null texts count as empty, null languages as ``und``; empty texts
have no pieces; a text of any length is read whole, hashes of its words in
blocks; repeated rows count each; an empty table gives no rows; ties rank by
counts and then by phrase in byte order; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

LEAST, MOST, FIRST = 100, 5, 2000
ROWS, MIN_BITS, MAX_BITS = 3, 16, 24
BLOCK = 1 << 15  # cells that travel together
SHARD = 200_000
TASK_BYTES = 1 << 29
HASH_BYTES = 1 << 16  # of text whose words are hashed at once
TEXT_BYTES = 1 << 22  # of text whose words are held at once
HELD = 1 << 22  # hashes that wait to be counted
PHRASES = 1 << 20  # different phrases that a task holds
UNKNOWN = "und"

#: Capital letters fall, marks that end a piece become line feeds, tabs become spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)
)
_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = (_powers(b, HASH_BYTES + 2) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def guarded(text: str) -> bytes:
    """The text's words between single spaces; a line feed is the word that divides pieces."""
    t = b" " + text.encode().translate(_FOLD).replace(b"\n", b" \n ") + b" "
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts as arrays: where they start and end in ``data``, their hashes, their text's language."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        self.data = b"\n".join(texts)
        buf = np.frombuffer(self.data, np.uint8)
        spaces = np.flatnonzero(buf == 32)
        self.starts, self.ends = spaces[:-1] + 1, spaces[1:]
        self.breaks = buf[self.starts] == 10
        self.lang = np.repeat(langs, [t.count(b" ") for t in texts])[:-1]
        self.hashes = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            a = self.starts[i]
            j = int(np.searchsorted(self.ends, a + HASH_BYTES, "right"))
            if j <= i:  # a word longer than a block
                self.hashes[i] = zlib.crc32(self.data[a : self.ends[i]])
                i += 1
                continue
            at, to = self.starts[i:j] - a, self.ends[i:j] - a
            # a polynomial's sums up to each byte: a word is a difference, moved to where it would start at 0
            sums = np.zeros(to[-1] + 1, np.uint64)
            np.cumsum(_WEIGHTS[buf[a : self.ends[j - 1]]] * _POWERS[: to[-1]], out=sums[1:])
            self.hashes[i:j] = (sums[to] - sums[at]) * _INVERSE[at]
            i = j

    def __len__(self) -> int:
        return len(self.starts)


class Grams:
    """Phrases that start at each word: hashes by length, and which of them the bits of earlier sketches admit."""

    def __init__(self, words: Words, seeds: np.ndarray, bits: list[np.ndarray]):
        self.words = words
        self.hash = [words.hashes * _ODD[0] + seeds[words.lang]]
        self.ok = [~words.breaks]
        if bits:
            self.ok[0] = self._admitted(0, bits[0])

    def _admitted(self, i: int, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ok[i]), bool)
        at = np.flatnonzero(self.ok[i])
        h = _mix(self.hash[i][at])
        for r, row in enumerate(bits):
            c = cells(h, r, row.size * 8)
            keep = row[c >> 3] >> (c & 7).astype(np.uint8) & 1 == 1
            at, h = at[keep], h[keep]
        out[at] = True
        return out

    def grow(self, bits: np.ndarray | None = None) -> None:
        """Phrases of one more word: those whose beginning and end are admitted, and that ``bits`` admit."""
        i = len(self.hash)
        self.hash.append(self.hash[-1][:-1] * _ODD[1] + self.hash[0][i:] + np.uint64(i))
        self.ok.append(self.ok[-1][:-1] & self.ok[-1][1:])
        if bits is not None:
            self.ok[i] = self._admitted(i, bits)

    def admitted(self, i: int) -> np.ndarray:
        return _mix(self.hash[i][self.ok[i]])


def runs(ordered: np.ndarray, firsts: bool = False) -> tuple:
    """The different values of a sorted array and how often each comes; where each begins, too, if firsts."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    out = ordered[first], np.diff(first, append=len(ordered))
    return (*out, first) if firsts else out


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((h * _ODD[row]) >> np.uint64(65 - int(width).bit_length())).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], langs: dict[str, int]) -> Iterator[Words]:
    """Words of the texts of (text, lang) batches, in groups of bounded size or one text."""
    for batch in batches:
        held, of, size = [], [], 0
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held.append(guarded(text.as_py() or ""))
            of.append(langs.setdefault(UNKNOWN if lang is None else lang, len(langs)))
            size += len(held[-1])
            if size >= TEXT_BYTES:
                yield Words(held, np.array(of))
                held, of, size = [], [], 0
        if held:
            yield Words(held, np.array(of))


def _seeds(langs: dict[str, int]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in langs], np.uint64) * _ODD[2]


def sketch(texts: DataFrame, level: int, earlier: list, width: int, least: int, most: int) -> np.ndarray:
    """Bits of the cells that reach ``least``, ROWS x width / 8 bytes: words (level 1), pairs (2), phrases of three and more (3)."""
    small, per_row = np.min_scalar_type(least), max(1, width // BLOCK)
    block = min(BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, width), small)
        langs: dict[str, int] = {}
        bits = [b.value for b in earlier]
        held: list[np.ndarray] = []

        def add() -> None:
            # equal phrases first, then equal cells: what is touched are the cells of different phrases, in order
            h, n = runs(np.sort(np.concatenate(held)))
            for r in range(ROWS):
                packed = np.sort(cells(h, r, width) << 32 | np.minimum(n, least))
                c, _, first = runs(packed >> 32, True)
                total = np.add.reduceat(packed & 0xFFFFFFFF, first) if len(first) else first
                table[r, c] = np.minimum(table[r, c] + total, least)
            held.clear()

        for words in _batches(batches, langs):
            grams = Grams(words, _seeds(langs), bits)
            if level > 1:
                grams.grow(bits[1] if level > 2 else None)
            if level < 3:
                held.append(grams.admitted(level - 1))
            else:
                for _ in range(most - 2):
                    grams.grow()
                    held.append(grams.admitted(len(grams.hash) - 1))
            if sum(map(len, held)) >= HELD:
                add()
        if held:
            add()
        blocks = table.reshape(-1, block)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())], names=["block", "cells"]
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(packed.as_py()), small).astype(np.uint32)
                sums[i] = got if i not in sums else np.minimum(sums[i] + got, least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())],
            names=["block", "cells"],
        )

    schema = "block long, cells binary"
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(count, schema).repartition(parts, "block").mapInArrow(total, schema).collect()
    out = np.zeros((ROWS * per_row, block // 8), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.cells, np.uint8)
    return out.reshape(ROWS, width // 8)


class Seen:
    """Phrases of a task and how often each came; what is known by its hash is counted without its letters.

    A hash stands for the first phrase that has it; another one is told by its length and its outer words, and counted by its letters.
    """

    def __init__(self):
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # in the hashes' order
        self.at = np.zeros(0, np.int64)  # places in phrases
        self.phrases: list[tuple[int, bytes]] = []
        self.counts = np.zeros(0, np.int64)
        self.odd: Counter = Counter()

    def __len__(self) -> int:
        return len(self.phrases) + len(self.odd)

    def add(self, grams: Grams, ok: np.ndarray, i: int) -> None:
        """Counts the phrases of i + 1 words that start where ok."""
        words, at = grams.words, np.flatnonzero(ok)
        spelled = lambda k: [(x, words.data[a:b]) for x, a, b in zip(
            words.lang[k].tolist(), words.starts[k].tolist(), words.ends[k + i].tolist(), strict=True)]
        h = grams.hash[i][at]
        check = (words.ends[at + i] - words.starts[at]).astype(np.uint64) * _ODD[0] + words.hashes[at] * _ODD[1] + words.hashes[at + i] * _ODD[2]
        order = np.argsort(h)
        at, check = at[order], check[order]
        h, n, first = runs(h[order], True)
        same = check == np.repeat(check[first], n)
        if not same.all():
            self.odd.update(spelled(at[~same]))
            n = np.add.reduceat(same.astype(np.int64), first)
        at, check = at[first], check[first]
        place = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == h[inside]
        alike = known.copy()
        alike[known] = self.checks[place[known]] == check[known]
        self.counts[self.at[place[alike]]] += n[alike]
        for phrase, k in zip(spelled(at[known & ~alike]), n[known & ~alike].tolist(), strict=True):
            self.odd[phrase] += k
        new, size = ~known, len(self.phrases)
        self.phrases += spelled(at[new])
        self.counts = np.concatenate([self.counts, n[new]])
        self.hashes = np.insert(self.hashes, place[new], h[new])
        self.checks = np.insert(self.checks, place[new], check[new])
        self.at = np.insert(self.at, place[new], np.arange(size, len(self.phrases)))

    def rows(self) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
        """Languages, phrases and counts, a part at a time."""
        for phrases, counts in ((self.phrases, self.counts.tolist()), (list(self.odd), list(self.odd.values()))):
            for a in range(0, len(phrases), BLOCK):
                part = phrases[a : a + BLOCK]
                yield [x for x, _ in part], [p for _, p in part], counts[a : a + BLOCK]


def admitted_phrases(texts: DataFrame, bits: list, most: int) -> DataFrame:
    """(lang, phrase, n): the phrases of two words and more that the bits admit and how often each occurs; and a null phrase with all words."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        words_of: Counter = Counter()
        seen = Seen()
        levels = [b.value for b in bits]

        def out(of: list[int], phrases: list[bytes | None], n: list[int]) -> pa.RecordBatch:
            names = list(langs)
            return pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in of], pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
            ], names=["lang", "phrase", "n"])

        for words in _batches(batches, langs):
            words_of.update(dict(enumerate(np.bincount(words.lang[~words.breaks], minlength=len(langs)).tolist())))
            grams = Grams(words, _seeds(langs), levels)
            for i in range(1, most):
                grams.grow(levels[1] if i == 1 else None)
                # longer phrases grow from all phrases whose pairs are admitted; their own bits decide here only
                seen.add(grams, grams.ok[1] if i == 1 else grams._admitted(i, levels[2]), i)
            if len(seen) >= PHRASES:
                yield from (out(*part) for part in seen.rows())
                seen = Seen()
        yield from (out(*part) for part in seen.rows())
        yield out(list(words_of), [None] * len(words_of), list(words_of.values()))

    found = texts.mapInArrow(collect, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def compiled(patterns: dict[str, list[str]]):
    """An automaton for each language, whose matches carry the pattern's number."""
    import ahocorasick

    out = {}
    for lang, phrases in patterns.items():
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(phrases):
            a.add_word(f" {p} ", i)
        a.make_automaton()
        out[lang] = a
    return out


_compiled: dict = {}  # of the shard that this worker counts


def count_patterns(texts: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(lang, phrase, f) of each pattern that occurs: occurrences in all texts, overlapping ones too.

    A task's counts travel as blocks of numbers in the patterns' order; the sums of a block become rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(patterns)
    key = uuid.uuid4().hex
    starts, total = {}, 0
    for lang, phrases in patterns.items():
        starts[lang], total = total, total + len(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _compiled.get("of") != key:
            _compiled.clear()
            _compiled.update(of=key, automata=compiled(shared.value))
        automata = _compiled["automata"]
        found = {lang: Counter() for lang in automata}
        number = itemgetter(1)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                lang = UNKNOWN if lang is None else lang
                if lang in automata and (text := text.as_py()):
                    found[lang].update(map(number, automata[lang].iter(guarded(text).decode())))
        sums = np.zeros(total, np.int64)
        for lang, counts in found.items():
            sums[starts[lang] + np.fromiter(counts.keys(), np.int64, len(counts))] = np.fromiter(counts.values(), np.int64, len(counts))
        cut = [(i, sums[i * BLOCK : (i + 1) * BLOCK]) for i in range(-(-total // BLOCK))]
        cut = [(i, zlib.compress(x.tobytes(), 1)) for i, x in cut if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int64()), pa.array([x for _, x in cut], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
        if sums:
            names = [(lang, p) for lang, phrases in shared.value.items() for p in phrases]
            for i, f in sums.items():
                some = np.flatnonzero(f)
                named = [names[i * BLOCK + j] for j in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in named], pa.string()), pa.array([x[1] for x in named], pa.string()), pa.array(f[some])],
                    names=["lang", "phrase", "f"],
                )

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(scan, "block long, sums binary").repartition(parts, "block").mapInArrow(add, "lang string, phrase string, f long")


def exact_counts(texts: DataFrame, wanted: DataFrame, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, f) for the (lang, phrase) rows of wanted, a written table; a shard at a time, over the texts of its languages."""
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    out = None
    for i, (langs, parts, part) in enumerate(dealt({r.lang: r["count"] for r in wanted.groupBy("lang").count().collect()}, shard)):
        patterns: dict[str, list[str]] = {}
        mine = wanted.filter(F.col("lang").isin(langs) & (F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part))
        for r in mine.select("lang", "phrase").toLocalIterator():
            patterns.setdefault(r.lang, []).append(r.phrase)
        counts = scratch.save(count_patterns(texts.filter(lang.isin(langs)), patterns), f"counts{i}")
        out = counts if out is None else out.unionByName(counts)
    if out is None:  # nothing is wanted
        return wanted.select("lang", "phrase", F.lit(0).cast("long").alias("f"))
    return out


def dealt(sizes: dict[str, int], shard: int) -> list[tuple[list[str], int, int]]:
    """Shards as (languages, parts, part): languages together while they fit, a larger one alone in several parts."""
    out: list[tuple[list[str], int, int]] = []
    room = 0
    for lang, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        parts = -(-n // shard)
        if parts == 1 and n <= room:
            out[-1][0].append(lang)
            room -= n
        else:
            out += [([lang], parts, i) for i in range(parts)]
            room = shard - n
    return out


def scored(counts: DataFrame, totals: DataFrame, least: int = LEAST) -> DataFrame:
    """counts(lang, phrase, f), totals(lang, n) -> lang, phrase, a, l, r, n, score of the candidates that no longer one covers."""
    several = counts.filter(F.instr("phrase", " ") > 0).filter(F.col("f") >= least).select("lang", "phrase", F.col("f").alias("a"))
    several = several.withColumn("w", F.split("phrase", " "))
    join = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(
        k.alias("k"), join(F.col("w"), F.lit(1), k).alias("left"), join(F.col("w"), k + 1, F.size("w") - k).alias("right"),
    ))
    rows = several.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    rows = rows.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    rows = rows.withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r"))
    rows = rows.withColumn("score", F.expr("over div under"))
    best = rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")
    # a phrase inside a longer one of the same count is also inside one of them that has one word more
    size = F.size("w")
    inner = F.array(join(F.col("w"), F.lit(1), size - 1), join(F.col("w"), F.lit(2), size - 1))
    covered = several.filter(size > 2).select("lang", "a", F.explode(inner).alias("phrase")).distinct()
    return best.join(covered, ["lang", "phrase", "a"], "left_anti")


def first_of_each(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """rank within lang; each of 64 parts of a language sends on its own first rows only."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = part.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def sized(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs(text, lang) in few tasks, and the bits of a cell's number.

    A task sends a sketch and its own different phrases, so tasks are as few as keep all cores busy to the end (whole
    waves of them), with TASK_BYTES of text at most; a row of the sketch has a cell for about 256 bytes of text, within bounds.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-size // (cores * TASK_BYTES)))
    return docs.select("text", "lang").coalesce(tasks), min(MAX_BITS, max(MIN_BITS, (size >> 8).bit_length()))


def collocations(
    docs: DataFrame, scratch: Scratch, least: int = LEAST, most: int = MOST, first: int | None = FIRST, bits: int | None = None, shard: int = SHARD,
) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score; all phrases, without rank, if first is None."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, fit = sized(docs)
    width = 1 << (bits or fit)
    levels: list = []
    for level in (1, 2, 3):
        levels.append(spark.sparkContext.broadcast(sketch(texts, level, levels, width, least, most)))
    admitted = scratch.save(admitted_phrases(texts, levels, most), "admitted")
    totals = admitted.filter("phrase is null").select("lang", "n")
    phrases = admitted.filter("phrase is not null").filter(F.col("n") >= least).select("lang", "phrase")
    ends = phrases.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))).alias("phrase"))
    wanted = scratch.save(phrases.unionByName(ends.distinct()), "wanted")
    rows = scored(exact_counts(texts, wanted, scratch, shard), totals, least)
    if first is None:
        return rows
    return first_of_each(rows, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, first: int = FIRST) -> str:
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM c),
s AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 : c.m], ' ') JOIN totals t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {first}
"""
