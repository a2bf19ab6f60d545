"""Whitening, phrases and packing against plain versions; links at the limit, coded WARC bodies, the classifier's forward pass."""

import collections
import gzip
import json
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import collocations, neardup, packing, textvec, toxicity, warc, whitening
from weftline.llm.common import Bloom, Scratch


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    data = (rng.normal(size=(400, 6)) @ mix / 8 + 3).astype(np.float32)
    rows = [(i % 390, v.tolist(), 1) for i, v in enumerate(data)]
    bad = [(900, None, 1), (901, [None] * 6, 1), (902, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (903, [float("inf")] * 6, 1), (904, [], 1), (905, [1.0], 1)]
    got = whitening.whiten(vectors(spark, rows + bad + [(None, data[0].tolist(), 1)]).repartition(7), components=4).toPandas()
    data = np.concatenate([data, data[:1]])
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in data]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = sorted(sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x)
    y = np.array(x, float) - np.array(sums) / n
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    assert len(got) == n * 4 and set(got.n) == {n} and sorted(got.component.unique()) == [1, 2, 3, 4]
    assert sorted(int(d) for d in got[got.component == 1].deviation) == exact
    for k in range(4):
        one = got[got.component == k + 1].sort_values(["deviation", "vec_id"])
        want = y @ vec[:, k] / np.sqrt(e[k])
        assert np.allclose(np.sort(np.abs(one.whitened)), np.sort(np.abs(want)), atol=1e-9)
        assert np.allclose(one.explained, e[k] / e.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    by_id = got[got.vec_id == 300].sort_values("component").whitened.to_numpy()
    assert np.allclose(np.abs(by_id), np.abs(y[300] @ vec[:, :4] / np.sqrt(e[:4])), atol=1e-9)


def test_whitening_of_degenerate_tables(spark):
    two = whitening.whiten_digest(vectors(spark, [(1, [0.0, 1.0, 2.0], 1), (2, [1.0, 1.0, 4.0], 1)])).collect()
    assert [r.whitened is None for r in sorted(two, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 2
    assert {r.deviation for r in two} == {64**2 + 128**2} and max(r.identity_error for r in two) < 1e-9
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.5], 1)] * 3)).collect()
    assert len(same) == 6 and {(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in same} == {(None, 0.0, 0, 0.0)}
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1)])).count() == 0


def test_merge_equals_one_pass_and_exact_deviation():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (1000, 5)).astype(float)
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 7, 400, 999])] + [None]
    left = right = None
    for p in parts:
        left = whitening.merged(left, p)
    for p in reversed(parts):
        right = whitening.merged(p, right)
    for m in (left, right):
        assert m.n == 1000 and np.allclose(m.mean, whole.mean, atol=1e-12) and np.allclose(m.scatter, whole.scatter, rtol=1e-12, atol=1e-7)
        assert list(m.sums) == [int(s) for s in x.sum(axis=0)]
    w = whitening.Whitener.fit(whole, 5)
    w.n, w.sums = 10**12, np.array([10**13] * 5, object)  # far over 64 bits
    assert w.deviations(x[:2]) == [sum((10**12 * int(c) - 10**13) ** 2 for c in row) for row in x[:2]]


def plain_packing(lengths, capacity):
    """Sequences of the same rule, one piece at a time."""
    bins, large = [], sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        a = large.pop(0)
        fit = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        bins.append(capacity - a - (large.pop(fit) if fit is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        room = [g for g in bins if g >= n]
        if room:
            bins[bins.index(min(room))] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_by_lengths(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 30, 100, 2048])
    top = rnd.choice([capacity, max(1, capacity // 3), max(1, capacity // 2)])
    pool = [rnd.randint(1, top) for _ in range(rnd.choice([1, 3, 40, 400]))]
    lengths = [rnd.choice(pool) for _ in range(rnd.choice([1, 2, 50, 600]))]
    counts = collections.Counter(lengths)
    plan = packing.Plan(counts, capacity)
    assert plan.sequences == plain_packing(lengths, capacity)
    keys, first_rank, first, each, offset = plan.arrays()
    held = collections.defaultdict(list)
    for n, c in counts.items():
        for r in range(c):
            i = np.searchsorted(keys, (n << packing.RANK_BITS) | r, "right") - 1
            k = r - first_rank[i]
            held[first[i] + k // each[i]].append((int(offset[i] + k % each[i] * n), n))
    assert sorted(held) == list(range(plan.sequences))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2


def test_packing_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    texts = [None, "", " ", "a<|endoftext|>b", "😀 ﷽ ͸ ͸ \U0001faf8", "x" * 5000, "word " * 6000, "\n\t  \r\n x"]
    texts += [" ".join(rnd.choice(["the", "house", "éà", "12345", "...", "Zz"]) for _ in range(rnd.randint(0, 900))) for _ in range(60)]
    rows = [(i % 50, t, 7) for i, t in enumerate(texts)] + [(None, "the end", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = packing.pack(docs, Scratch(spark, "t"), capacity=256, ids=True).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [0, len(ids)] if len(ids) <= 256 else sorted({0, *range(len(ids), 0, -256)})
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
        assert len(r.ids) == r.length
    assert len(by) == plain_packing([r.length for r in got], 256)
    for pieces in by.values():
        at = 0
        for o, n, _ in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    packed = packing.sequences(packing.pack(docs, Scratch(spark, "t"), capacity=256, ids=True)).collect()
    assert sum(len(r.ids) for r in packed) == sum(r.length for r in got) and max(len(r.ids) for r in packed) <= 256
    assert packing.pack(docs.limit(0), Scratch(spark, "t")).count() == 0


def plain_phrases(rows, least, first):
    words_of = collections.Counter()
    f = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words_of[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        cuts = [(1000 * a * words_of[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            continue
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], words_of[lang]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, x in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(x)[:first])
    )


@pytest.mark.parametrize("settings", [{}, {"bits": 4, "shard": 7}, {"bits": 17, "first": 5}])
def test_phrases_against_plain_counts(spark, settings):
    rnd = random.Random(8)
    vocab = ["the", "The", "of", "a", "a", "new", "york", "é", "😀", " x", "İ", "it's", "of\x1cb"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", " \n ", "; "]
    rows = [("".join(rnd.choice(vocab) + rnd.choice(marks) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "fr", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" .,", "de"), ("a " * 3000, "en"), ("New York " * 40, "fr"), ("q" * 3000 + " w " + "q" * 3000, "fr")] + [("b c d e f g", "es")] * 12
    docs = spark.createDataFrame([(t, g, 3) for t, g in rows], "text string, lang string, rank int").repartition(6)
    got = collocations.collocations(docs, Scratch(spark, "t"), least=10, **settings).collect()
    want = plain_phrases(rows, 10, settings.get("first", 2000))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want and len(want) > 10
    assert collocations.collocations(docs.limit(0), Scratch(spark, "t"), least=10).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    big = 10**12
    counts = spark.createDataFrame([("en", "x y", big), ("en", "x", 3 * big), ("en", "y", 7 * big)], "lang string, phrase string, f long")
    (r,) = collocations.scored(counts, spark.createDataFrame([("en", 10**14)], "lang string, n long")).collect()
    assert r.score == 1000 * big * 10**14 // (21 * big * big)


def test_words_in_blocks(monkeypatch):
    texts = [collocations.guarded(t) for t in ("ab cd, ef", "", "longword " * 20 + "ab", "x" * 100 + " cd")]
    whole = collocations.Words(texts, np.arange(4)).hashes
    monkeypatch.setattr(collocations, "HASH_BYTES", 12)
    w = collocations.Words(texts, np.arange(4))
    spelled = [w.data[a:b] for a, b in zip(w.starts, w.ends)]
    for h in (whole, w.hashes):
        assert all((h[i] == h[j]) == (spelled[i] == spelled[j]) for i in range(len(h)) for j in range(len(h)))


def test_filter_grows_with_its_keys(spark):
    small, large = (Bloom(spark.range(n), "id") for n in (10, 300_000))
    assert small.bits == 1 << 16 and large.bits == 1 << 23
    passed = spark.range(10**6, 10**6 + 50_000).select(large.flag("id").alias("f")).filter("f").count()
    assert passed < 50_000 / 200


def test_no_link_lost_at_the_limit(spark):
    """25,000 pairs of 39 words whose middle one differs: 30 of 40 shingles."""
    first = {int(v) for order in neardup._ORDERS for v in order[: neardup.MIN_DEPTH]}
    assert len(first) == neardup.TREES * neardup.MIN_DEPTH == neardup.POOL and all(len(set(o)) == neardup.DEPTH for o in neardup._ORDERS)
    n = 25_000
    pairs = spark.range(2 * n).selectExpr(
        "id as doc_id",
        "concat_ws(' ', transform(sequence(0, 38), i -> if(i = 19, concat('m', id), concat('w', substr(sha2(concat(id div 2, '-', i), 256), 1, 8))))) as text")
    got = neardup.near_duplicates(pairs, Scratch(spark, "t"))
    lost = got.filter("component_id <> doc_id - doc_id % 2").count()
    assert lost == 0 and got.count() == 2 * n


class PlainText(HTMLParser):
    """Text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "iframe", "textarea")
        if tag in warc._BLOCKS and not self.hidden:
            self.out.append("\0")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "iframe", "textarea"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in warc._BLOCKS and not self.hidden:
            self.out.append("\0")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\0", ""))


def plain_text(page):
    p = PlainText()
    p.feed(page)
    p.close()
    return [x for x in (" ".join(line.split()) for line in "".join(p.out).split("\0")) if x]


def test_page_text_against_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    rnd = random.Random(6)
    tags = ["p", "b", "div", "li", "h1", "span", "td", "script", "style", "noscript"]
    for _ in range(300):
        parts, stack = [], []
        for _ in range(rnd.randint(1, 30)):
            if stack and (rnd.random() < 0.4 or stack[-1] in ("script", "style", "noscript")):
                parts += ["hidden x", f"</{stack.pop()}>"]
            elif rnd.random() < 0.5:
                stack.append(rnd.choice(tags))
                parts.append(f"<{stack[-1]}" + rnd.choice(["", " class='a>b'", ' id="x"', " data-y=1"]) + ">")
            parts.append(rnd.choice(["word ", "a &amp; b", "&eacute;", " \n ", "<br>", "<!-- no <p> -->", "1 &lt; 2 "]))
        pages.append("".join(parts) + "".join(f"</{t}>" for t in reversed(stack)))
    for page in pages:
        assert warc.read_page(page or "")["text"].split("\n") == (plain_text(page or "") or [""]), page


def test_coded_and_other_bodies():
    def derived(body, *headers, kind="text/html"):
        lines = [f"Content-Type: {kind}"] * bool(kind) + list(headers)
        block = ("HTTP/1.1 200 OK\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body
        return {what: data for what, _, data, _ in warc.derive([("WARC-Record-ID", "<urn:1>")], block)}

    page = "<p>grün</p><p>hi</p>".encode()
    chunks = lambda b, n=5: b"".join(b"%x;e=1\r\n%s\r\n" % (len(b[i : i + n]), b[i : i + n]) for i in range(0, len(b), n)) + b"0\r\n\r\n"
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = raw.compress(page) + raw.flush()
    text = "grün\nhi".encode()
    chunked = "Transfer-Encoding: chunked"
    assert derived(page)["conversion"] == text
    assert derived(chunks(page), chunked)["conversion"] == text
    assert derived(page, chunked)["conversion"] == text  # already put together
    assert derived(chunks(page)[:-9], chunked)["conversion"].startswith("grün".encode())
    assert derived(gzip.compress(page[:9]) + gzip.compress(page[9:]), "Content-Encoding: gzip")["conversion"] == text
    assert derived(chunks(gzip.compress(page)), chunked, "Content-Encoding: GZIP")["conversion"] == text
    assert derived(zlib.compress(page), "Content-Encoding: deflate")["conversion"] == text
    assert derived(raw, "Content-Encoding: deflate")["conversion"] == text
    assert derived(page, "Content-Encoding: gzip")["conversion"] == text  # already unpacked
    assert set(derived(b"\x8b\x03", "Content-Encoding: br")) == {"metadata"}
    assert set(derived(b"\x89PNG\r\n\x1a\n", kind="image/png")) == {"metadata"}
    assert derived(b"a <b> c\n", kind="text/plain; charset=utf-8")["conversion"] == b"a <b> c\n"
    latin = "<meta charset='ISO-8859-1'><p>grün\x80</p>".replace("\x80", "€").encode("cp1252")
    got = derived(latin)
    assert got["conversion"] == "grün€".encode() and json.loads(got["metadata"])["html"]["charset"] == "cp1252"
    assert derived('<meta http-equiv="Content-Type" content="text/html; charset=koi8-r"><p>мир'.encode("koi8-r"))["conversion"] == "мир".encode()
    assert derived("﻿<p>x".encode("utf-16-le"), kind="text/html; charset=latin1")["conversion"] == b"x"
    assert derived("<p>é".encode("latin-1"), kind="text/html; charset=latin1")["conversion"] == "é".encode()
    assert derived(page, kind="")["conversion"] == text
    assert list(warc.srcset(" data:image/png;base64,AA== 1x, b.png 2x,c(1,2).png, d.png w(1,2),,e ")) == ["data:image/png;base64,AA==", "b.png", "c(1,2).png", "d.png", "e"]


def test_toxicity_forward_pass_is_plain_convolution():
    """A fitted model's scores, by loops over every word, filter and position."""
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    toxic = np.array([int(vocab[0] in t.split() and vocab[1] in t.split() or vocab[2] in t.split()) for t in texts])

    def features(some):
        for h, first in toxicity._features(pa.array(some, pa.string())):
            yield from (h[first[i] : first[i + 1]] for i in range(len(first) - 1))

    model = toxicity.fit(lambda: features(texts), toxic)
    assert len(model.known) and any(f.shape[0] == 3 for f in model.filters)
    known = {int(h): i for i, h in enumerate(model.known)}
    for text, h in zip(texts + ["", "zz zz"], features(texts + ["", "zz zz"])):
        embedded = np.zeros((len(h), toxicity.DIM))
        for i, row in enumerate(h):
            for x in row:
                if int(x) in known:
                    embedded[i] += model.ready[known[int(x)]]
        pooled, at = np.zeros(len(model.out)), 0
        for f in model.filters:
            for k in range(f.shape[2]):
                for i in range(len(h)):
                    s = model.bias[at + k] + sum(float(embedded[i + j] @ f[j, :, k]) for j in range(len(f)) if i + j < len(h))
                    pooled[at + k] = max(pooled[at + k], s)
            at += f.shape[2]
        z = float(pooled @ model.out + model.offset) - model.thresholds[toxicity.languages(h, np.array([0, len(h)]))[0]]
        got = float(model.scores(h, np.array([0, len(h)]))[0])
        assert abs(got - 1 / (1 + math.exp(-max(-50, min(50, z))))) < 1e-4, text


def test_phrases_dealt_by_language():
    deal = collocations.dealt({"en": 25, "fr": 9, "de": 4, "es": 3, "und": 10}, 10)
    assert deal == [(["es", "de"], 1, 0), (["fr"], 1, 0), (["und"], 1, 0), (["en"], 3, 0), (["en"], 3, 1), (["en"], 3, 2)]
    assert collocations.dealt({}, 10) == []


def test_phrases_of_one_hash_stay_apart(monkeypatch):
    texts = [collocations.guarded(t) for t in ("ab cd, ab cd", "ef gh ab cd ef gh", "ij kl")]
    words = [collocations.Words(texts[:2], np.array([0, 0])), collocations.Words(texts[1:], np.array([0, 1]))]
    for same in (False, True):
        seen = collocations.Seen()
        for w in words:
            grams = collocations.Grams(w, np.arange(2, dtype=np.uint64), [])
            grams.grow()
            if same:
                grams.hash[1][:] = 7
            seen.add(grams, grams.ok[1], 1)
        got = collections.Counter()
        for langs, phrases, counts in seen.rows():
            got.update({(k, p): 0 for k, p in zip(langs, phrases)})
            for k, p, n in zip(langs, phrases, counts):
                got[k, p] += n
        pairs = {b"ab cd": 4, b"ef gh": 4, b"gh ab": 2, b"cd ef": 2}
        assert got == {**{(0, p): n for p, n in pairs.items()}, (1, b"ij kl"): 1}


@pytest.mark.parametrize("shard", [200_000, 3])
def test_only_phrases_that_reach_the_threshold_are_dealt(spark, monkeypatch, shard):
    rows = [(f"w{i} x{i} w{i} x{i}", "en") for i in range(40)] + [("new york city", "en"), ("bon jour", "fr")] * 12
    asked, texts_of = [], []
    plain = collocations.count_patterns

    def counted(texts, patterns):
        asked.append({p for ps in patterns.values() for p in ps})
        texts_of.append({r.lang for r in texts.collect()} - set(patterns))
        return plain(texts, patterns)

    monkeypatch.setattr(collocations, "count_patterns", counted)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), Scratch(spark, "t"), least=10, bits=4, shard=shard)
    assert {(r.lang, r.phrase, r.a) for r in got.collect()} == {("en", "new york city", 12), ("fr", "bon jour", 12)}
    assert set().union(*asked) == {"new york", "york city", "new york city", "new", "york", "city", "bon jour", "bon", "jour"}
    assert not any(texts_of) and (shard > 3 or len(asked) > 2)
