"""Toxicity by a convolutional text classifier, trained and run in numpy.

A word of letters and digits counts as itself and by its beginnings (PREFIXES),
so that forms of a word that were never seen are read by their stem. Each of
these is hashed into two buckets, and all their vectors add up to the word's
embedding (two features share one only if both buckets meet). Filters of several
widths slide over the words, the largest response of each filter over the
whole text is kept (max pooling, never below 0), and a linear layer gives a
logit. A threshold for the language is subtracted, so that a score of 0.5 is
the decision. The language is guessed from function words of the text itself;
no column but the text is an input of a score.

The fit uses a bounded sample of labelled rows (MAX_TOXIC and MAX_CLEAN, by
hash order of the id, MAX_BYTES of text in all), one text for an id, and runs
in one task; CALIBRATION of them are kept from the gradient and set the
thresholds. Scoring is one pass over all rows without a shuffle; the model has
a bounded size (the embeddings of the sample's telling features) and is broadcast.

Edge cases: null counts as empty text; a text without words has pooled values
of 0, so its score is the bias's; every row gives a row, repeated ids too; an id
that comes with several texts is learnt by the smallest, one with several labels
as toxic; labelled texts over MAX_TEXT bytes are scored but not learnt from; a
training set without both labels gives a model that scores the share of toxic
rows (0 without rows) for every text; null labels are left out; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec
from .common import crc_mod, small_batches

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.05, 1e-4
MAX_TOXIC, MAX_CLEAN, MAX_TEXT, MAX_BYTES = 2000, 3000, 1 << 20, 1 << 26
#: A word's beginnings, in bytes.
PREFIXES = (4, 5, 6, 7)
#: A feature has an embedding if so many training texts hold it (rarer ones could only be learnt by heart) and its
#: log odds are so many standard errors from 0.
MIN_TEXTS, MIN_ERRORS = 5, 2.0
CALIBRATION = 5  # one row in so many
EMPTY = 20  # one clean empty text for so many rows
FOLDS, HELD_OUT = 5, 0

#: Function words by language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "with", "this"),
    "fr": ("le", "et", "les", "des", "une", "pour", "dans", "qui", "sur", "par"),
    "de": ("der", "die", "und", "das", "den", "von", "mit", "ist", "nicht", "ein"),
    "es": ("el", "los", "y", "que", "las", "por", "con", "una", "para", "del"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _hash_words(words: list[str]) -> np.ndarray:
    raw, offs = textvec.buffers(pa.array(words))
    with np.errstate(over="ignore"):
        return textvec.starts(raw[: offs[-1]], offs, ())[0][:, 0]


_FUNCTION, _LANGUAGE = (np.concatenate(x) for x in zip(*[
    (_hash_words(list(v)), np.full(len(v), k)) for k, v in enumerate(FUNCTION_WORDS.values())], strict=True))
_FUNCTION, _LANGUAGE = _FUNCTION[np.argsort(_FUNCTION)], _LANGUAGE[np.argsort(_FUNCTION)]


def languages(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES for each text: the one with most function words, "other" without any."""
    at = np.minimum(np.searchsorted(_FUNCTION, h[:, 0]), len(_FUNCTION) - 1)
    hit = np.flatnonzero(_FUNCTION[at] == h[:, 0])
    text, kinds = np.searchsorted(first, hit, "right") - 1, len(FUNCTION_WORDS)
    votes = np.bincount(text * kinds + _LANGUAGE[at[hit]], minlength=(len(first) - 1) * kinds).reshape(-1, kinds)
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), kinds)


class Model:
    """Embeddings, filters and the linear layer; thresholds by language."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (2 * BUCKETS + 1, DIM)).astype(np.float32)
        self.table[-1] = 0
        self.filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.uniform(0.2, 1.0, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out[1::2] *= -1
        self.offset = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)
        self.constant: float | None = None
        self.known = np.zeros(0, np.uint64)  # sorted hashes of the features that enough training texts hold
        self.ready: np.ndarray | None = None  # their embeddings, in place of the table when the fit is done

    def buckets(self, h: np.ndarray) -> np.ndarray:
        """The rows of the table for the features of each word, two each; features that aren't known have the last row, zeros."""
        mask = np.uint64(BUCKETS - 1)
        two = np.stack([h & mask, ((h >> np.uint64(24)) & mask) + np.uint64(BUCKETS)], axis=2).astype(np.int32)
        two[self.places(h) == len(self.known)] = 2 * BUCKETS
        return two.reshape(len(h), 2 * h.shape[1])

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each feature among the known ones, their number if it isn't there."""
        at = np.searchsorted(self.known, h)
        at[np.append(self.known, np.uint64(0))[at] != h] = len(self.known)
        return at

    def embed(self, two: np.ndarray) -> np.ndarray:
        e = np.zeros((len(two), DIM), np.float32)
        for k in range(two.shape[1]):
            some = np.flatnonzero(two[:, k] < 2 * BUCKETS)
            e[some] += self.table[two[some, k]]
        return e

    def embed_known(self, h: np.ndarray) -> np.ndarray:
        """The same from features, by the embeddings of the known ones, which is all that a fitted model holds."""
        e = np.zeros((len(h), DIM), np.float32)
        for k in range(h.shape[1]):
            at = self.places(h[:, k])
            some = np.flatnonzero(at < len(self.known))
            e[some] += self.ready[at[some]]
        return e

    def finish(self) -> None:
        self.ready, self.table = self.embed(self.buckets(self.known[:, None])), None

    def shorten(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that a filter can tell from others: those with a known feature, as many more on both sides as a filter is
        wide, and as many at a text's start. Runs of words that embed to zero give all their filters' response with these."""
        n, wide = len(h), max(WIDTHS)
        near = np.zeros(n, bool)
        for k in range(h.shape[1]):
            near |= self.places(h[:, k]) < len(self.known)
        keep = near.copy()
        for k in range(1, wide + 1):
            keep[k:] |= near[:-k]
            keep[:-k] |= near[k:]
        head = first[:-1, None] + np.arange(wide)
        keep[head[head < first[1:, None]]] = True
        at = np.zeros(n + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        return h[keep], at[first]

    def responses(self, e: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A row for each word: what the filters give from it on, zeros beyond its text's last word."""
        cols = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        part = e @ cols
        out, at = [], 0
        room = last - np.arange(len(e))
        for w in WIDTHS:
            r = part[:, at : at + FILTERS].copy()
            for j in range(1, w):
                more = part[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
                r[: len(e) - j] += more * (room[: len(e) - j] >= j)[:, None]
            out.append(r)
            at += w * FILTERS
        return np.concatenate(out, axis=1) + self.bias

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        pooled = np.zeros((len(n), len(self.out)), np.float32)
        some = np.flatnonzero(n > 0)
        if len(some):
            last = np.repeat(first[1:] - 1, n)
            r = self.responses(self.embed_known(h), last)
            pooled[some] = np.maximum(np.maximum.reduceat(r, first[:-1][some], axis=0), 0)
        return pooled @ self.out + self.offset

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        lang = languages(h, first)
        z = self.logits(*self.shorten(h, first)).astype(np.float64) - self.thresholds[lang]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class _Ada:
    """Adagrad for a dense array or for some rows of one."""

    def __init__(self, x: np.ndarray, rate: float):
        self.x, self.rate, self.g2 = x, rate, np.full(x.shape, 1e-6, np.float32)

    def step(self, g: np.ndarray, rows=slice(None)) -> None:
        self.g2[rows] += g * g
        self.x[rows] -= self.rate * g / np.sqrt(self.g2[rows])


def fit(read: Callable[[], Iterator[np.ndarray]], toxic: np.ndarray, seed: int = 4) -> Model:
    """read() goes over the texts' features, a row for each word; it is called twice, so that only words that matter are held."""
    model = Model(seed)
    toxic = np.asarray(toxic)
    if not len(toxic) or toxic.min() == toxic.max():
        model.constant, model.table = float(toxic.mean()) if len(toxic) else 0.0, None
        return model
    model.known = _telling(read(), toxic)
    texts, lang = [], []
    for h in read():
        whole = np.array([0, len(h)])
        texts.append(model.shorten(h, whole)[0])
        lang.append(int(languages(h, whole)[0]))
    # empty texts are clean: what says nothing isn't toxic
    more = len(texts) // EMPTY + 1
    texts += [np.zeros((0, 1 + len(PREFIXES)), np.uint64)] * more
    lang = np.array(lang + [len(FUNCTION_WORDS)] * more)
    toxic = np.concatenate([toxic, np.zeros(more, toxic.dtype)])
    two = [model.buckets(h) for h in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[::CALIBRATION]
    train = np.setdiff1d(order, held)
    if len(set(toxic[train])) < 2:
        train = order
    weight = np.where(toxic == 1, 0.5 / max(toxic[train].mean(), 1e-3), 0.5 / max(1 - toxic[train].mean(), 1e-3))
    _start_from_counts(model, [two[i] for i in train], toxic[train])
    ada = {k: _Ada(getattr(model, k), RATE) for k in ("table", "bias", "out")}
    ada_f = [_Ada(f, RATE) for f in model.filters]
    groups = np.repeat(np.arange(len(WIDTHS)), FILTERS)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            ids = train[at : at + BATCH]
            model.offset -= _offset_step(model, toxic, weight, [i for i in ids if not len(two[i])])
            ids = [i for i in ids if len(two[i])]
            if not ids:
                continue
            words = np.concatenate([two[i] for i in ids])
            n = np.array([len(two[i]) for i in ids])
            ends = np.cumsum(n)
            starts = ends - n
            last = np.repeat(ends - 1, n)
            e = model.embed(words)
            r = model.responses(e, last)
            best = np.stack([r[s:t].argmax(axis=0) + s for s, t in zip(starts, ends, strict=True)])
            top = np.take_along_axis(r, best, axis=0)
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.offset, -30, 30)))
            g = ((p - toxic[ids]) * weight[ids] / len(ids)).astype(np.float32)
            g_pool = g[:, None] * model.out * (top > 0)
            g_out, g_bias = pooled.T @ g + DECAY * model.out, g_pool.sum(axis=0)
            model.offset -= np.float32(RATE * g.sum())
            g_e: dict[str, list] = {"row": [], "g": []}
            for k, w in enumerate(WIDTHS):
                cols = np.flatnonzero(groups == k)
                where, gp = best[:, cols], g_pool[:, cols]
                g_f = np.zeros_like(model.filters[k])
                for j in range(w):
                    inside = where + j <= last[where]
                    at_j = np.minimum(where + j, len(e) - 1)
                    gj = np.where(inside, gp, 0)
                    g_f[j] = np.einsum("bfd,bf->df", e[at_j], gj)
                    live = gj != 0
                    g_e["row"].append(at_j[live])
                    g_e["g"].append(gj[live][:, None] * np.broadcast_to(model.filters[k][j].T, (*gj.shape, DIM))[live])
                ada_f[k].step(g_f + DECAY * model.filters[k])
            row, ge = np.concatenate(g_e["row"]), np.concatenate(g_e["g"])
            if len(row):
                at, k = np.nonzero(words[row] < 2 * BUCKETS)
                uniq, back = np.unique(words[row[at], k], return_inverse=True)
                total = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(total, back, ge[at])
                ada["table"].step(total, uniq)
            ada["out"].step(g_out)
            ada["bias"].step(g_bias)
    model.finish()
    _calibrate(model, [texts[i] for i in held], lang[held], toxic[held])
    return model


def _log_odds(in_clean: np.ndarray, in_toxic: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Smoothed log odds from the numbers of texts that hold something."""
    smooth = 2.0
    return np.log((in_toxic + smooth * toxic / clean) / (toxic + 2 * smooth * toxic / clean)) - np.log(
        (in_clean + smooth) / (clean + 2 * smooth)
    )


def _telling(texts: Iterator[np.ndarray], toxic: np.ndarray, chunk: int = 500) -> np.ndarray:
    """Sorted features that enough texts hold and that tell the labels apart."""
    seen, counts, labels = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), iter(toxic)
    while some := [np.unique(h) for h in itertools.islice(texts, chunk)]:
        label = np.repeat(list(itertools.islice(labels, len(some))), [len(x) for x in some])
        every, at = np.unique(np.concatenate([seen, *some]), return_inverse=True)
        total = np.zeros((len(every), 2), np.int64)
        total[at[: len(seen)]] = counts
        for y in (0, 1):
            total[:, y] += np.bincount(at[len(seen) :][label == y], minlength=len(every))
        seen, counts = every, total
    n0, n1 = counts[:, 0], counts[:, 1]
    odds = _log_odds(n0, n1, int((toxic == 0).sum()), int((toxic == 1).sum()))
    error = np.sqrt(1 / (n0 + 0.5) + 1 / (n1 + 0.5))
    return seen[(n0 + n1 >= MIN_TEXTS) & (seen > 0) & (np.abs(odds) >= MIN_ERRORS * error)]


def _offset_step(model: Model, toxic: np.ndarray, weight: np.ndarray, empty: list[int]) -> np.float32:
    """What texts without words, whose logit is the offset, take from it."""
    p = 1 / (1 + np.exp(-float(model.offset)))
    return np.float32(RATE * sum((p - toxic[i]) * weight[i] for i in empty) / BATCH)


def _start_from_counts(model: Model, two: list[np.ndarray], toxic: np.ndarray) -> None:
    """First coordinate of each bucket: smoothed log odds of the texts that hold it; one filter of each width starts there."""
    counts = np.zeros((2, 2 * BUCKETS + 1), np.float32)
    for t, y in zip(two, toxic, strict=True):
        counts[int(y), np.unique(t)] += 1
    odds = _log_odds(*counts, (toxic == 0).sum(), (toxic == 1).sum())
    odds[-1] = 0
    model.table[:, 0] += 0.5 * odds.astype(np.float32)
    for f in model.filters:
        f[0, 0, 0] = 1.0


def _calibrate(model: Model, texts: list[np.ndarray], lang: np.ndarray, toxic: np.ndarray) -> None:
    """For each language the logit with the fewest errors on held rows; with few rows, that of all."""
    z = []
    for at in range(0, len(texts), BATCH):
        some = texts[at : at + BATCH]
        first = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
        z.append(model.logits(np.concatenate(some), first))
    z = np.concatenate([*z, np.zeros(0)])

    def best(z: np.ndarray, y: np.ndarray) -> float:
        if len(set(y)) < 2:
            return 0.0
        order = np.argsort(z)
        z, y = z[order], y[order]
        # toxic rows count as many times as keeps both kinds even
        w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) + 1
        errors = np.concatenate([[0], np.cumsum(np.where(y == 1, w, 0))]) + np.concatenate(
            [np.cumsum(np.where(y == 0, w, 0)[::-1])[::-1], [0]]
        )
        low = np.flatnonzero(errors <= errors.min() + 1e-9)
        k = low[len(low) // 2]
        return float((z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2)

    model.thresholds[:] = best(z, toxic)
    for k in range(len(LANGUAGES)):
        some = lang == k
        if some.sum() >= 60 and toxic[some].sum() >= 10:
            model.thresholds[k] = best(z[some], toxic[some])
    # never below what a text without evidence has
    model.thresholds[:] = np.maximum(model.thresholds, model.offset + 0.1)


def _features(column: pa.Array, size: int = textvec.PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    with np.errstate(over="ignore"):
        for _, raw, offs in textvec.pieces(column, size):
            yield textvec.starts(raw, offs, PREFIXES)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, toxic: the whole sample -> the model."""
    if not (rows := list(batches)):
        return
    sample = pa.Table.from_batches(rows).sort_by("doc_id")

    def read() -> Iterator[np.ndarray]:
        for column in sample.column(1).chunks:
            for h, first in _features(column, 1 << 18):
                yield from (h[first[i] : first[i + 1]] for i in range(len(first) - 1))

    model = fit(read, sample.column(2).to_numpy().astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; one row with the model comes back."""
    usable = labels.filter(crc_mod("doc_id", FOLDS) != HELD_OUT).filter("doc_id is not null and toxic is not null")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = None
    for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        some = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    # MAX_TOXIC + MAX_CLEAN rows at most, and so many ids with one text each
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= MAX_TEXT)
    texts = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rank = W.orderBy(F.xxhash64("doc_id"), "doc_id")
    # lengths alone pass through one task, the texts that fit are read again
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).withColumn("sum", F.sum("size").over(rank))
    sample = texts.join(F.broadcast(sizes.filter(F.col("sum") <= MAX_BYTES).select("doc_id")), "doc_id")
    found = sample.select("doc_id", "text", "toxic").mapInArrow(_fit_task, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(lambda: iter(()), np.zeros(0, np.int64))


def score_column(model: Model, spark) -> Callable:
    """Function of a text column that gives its score; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        got = [np.zeros(0)]
        with np.errstate(over="ignore"):
            for h, first in _features(text, 1 << 18):
                got.append(shared.value.scores(h, first))
        return pa.array(np.concatenate(got), pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    score = score_column(model, docs.sparkSession)
    scored = docs.select(
        F.col("doc_id").cast("long"), (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows of docs and score all of docs."""
    small_batches(docs.sparkSession)
    return score_documents(docs, train_on(docs, labels))
