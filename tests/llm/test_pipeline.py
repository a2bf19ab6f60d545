"""Each stage of the pipeline against brute force over what its predecessor kept."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline as P
from test_ops import brute_components
from weftline.llm import mixing
from weftline.llm.common import Scratch, keyed


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(9)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocab = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(500)]
    docs, labels = [], []
    for i in range(500):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 60))] + ["the", "of"]
        bad = i % 5 == 0
        if bad:
            w[3:3] = rnd.sample(["vilex", "horrax", "foulex"], 2)
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    clean = [t for i, t in docs if i % 5]
    for k in range(40):
        docs.append((500 + k, clean[k].replace(" ", "  ")))
        near = clean[60 + k].split()
        near[0] = "changed"
        docs.append((600 + k, " ".join(near)))
    docs += [(700, None), (701, ""), (None, "a null id"), (None, "a null id")]
    # a repeated row, an id with a second text that is a copy, one with a second text of its own
    docs += [(1, docs[1][1]), (8, docs[3][1]), (4, "quite another text of document four")]
    rows = [(i, t, "en" if k % 3 else "fr", f"src{k % 4}" if k % 11 else None, k, k % 2 == 0) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, row long, maybe boolean"
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def fill(amount, children):
    """children: (weight, capacity, key); what each gets of the amount, in integers, smallest capacity for its weight first."""
    got, rest, w = {}, amount, sum(x for x, _, _ in children)
    order = sorted(children, key=lambda c: (c[0] == 0, c[1] / c[0] if c[0] else 0, c[2]))
    for n, (x, cap, key) in enumerate(order):
        if x and cap * w <= rest * x:
            got[key], rest, w = cap, rest - cap, w - x
        else:
            return got | {k: min(c, y * rest // w) if w else 0 for y, c, k in order[n:]}
    return got


def brute_mix(rows, fraction, weights):
    """Rows that a budget of the tokens selects, each at most once: k of (k, doc_id, text, lang, source)."""
    words = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    leaf_of = {}
    for k, _, t, lang, source in rows:
        number = re.search("([0-9]{1,9})$", source or "")
        leaf_of[k] = (mixing.DOMAINS[int(number[1]) % 3 if number else 0], lang or "", source or "")
    supply = collections.Counter()
    for k, _, t, _, _ in rows:
        supply[leaf_of[k]] += words(t)
    weight = lambda level, v: weights[level].get(v, weights[level]["*"])
    cap = lambda p: sum(n for leaf, n in supply.items() if leaf[: len(p)] == p)
    budget = {(): sum(supply.values()) * fraction[0] // fraction[1]}
    for depth, level in enumerate(("domain", "lang", "source")):
        nodes = sorted({leaf[: depth + 1] for leaf in supply})
        for parent in {n[:-1] for n in nodes}:
            budget |= fill(budget[parent], [(weight(level, n[-1]), cap(n), n) for n in nodes if n[:-1] == parent])
    out = set()
    for leaf, n in supply.items():
        whole, rest = divmod(budget[leaf], n) if n else (0, 0)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        order = sorted((md5(":".join(["mix", str(whole), *([str(i)] if i is not None else []), md5(t or "")])), k, words(t))
                       for k, i, t, _, _ in rows if leaf_of[k] == leaf)
        before = 0
        for _, k, w in order:
            if whole or before < rest:
                out.add(k)
            before += w
    return out


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    kept = [{r.row: r for r in docs.collect()}]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        out.write.parquet(f"{data}/{name}")
        docs = spark.read.parquet(f"{data}/{name}")
        kept.append({r.row: r for r in docs.collect()})
        assert docs.count() == len(kept[-1])
    whole, clean, once, apart, mixed = kept
    assert {r.doc_id for r in whole.values()} - {r.doc_id for r in clean.values()} == set(range(0, 500, 5))  # these and no clean one
    last = lambda r: (r.doc_id is None, r.doc_id)
    groups = collections.defaultdict(list)
    for r in clean.values():
        groups[re.sub(r"[ \t-\r]+", " ", r.text or "")].append(r)
    assert len(once) == len(groups)
    assert all(sum(r.row in once for r in g) == 1 for g in groups.values())
    assert {r.doc_id for r in once.values()} == {min(g, key=last).doc_id for g in groups.values()}
    assert sum(r.doc_id == 4 for r in once.values()) == 2 and sum(r.doc_id == 8 for r in once.values()) == 1
    number = {k: n for n, k in enumerate(sorted(once, key=lambda k: last(once[k])))}
    _, comp = brute_components([(number[k], r.text) for k, r in once.items()])
    assert {number[k] for k in apart} == {i for i, c in comp.items() if i == c}
    rows = [(k, r.doc_id, r.text, r.lang, r.source) for k, r in apart.items()]
    assert set(mixed) == brute_mix(rows, P.MIX["fraction"], mixing.WEIGHTS)
    ids = P.STAGES[-1][1](spark, docs, data).collect()
    assert sorted(r.doc_id for r in ids if r.doc_id is not None) == sorted(r.doc_id for r in mixed.values() if r.doc_id is not None)
    assert len(ids) == len(mixed) and all(len(r.ids) == r.n_tokens for r in ids)


def test_empty_tables(spark, data, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_is_repeatable(spark, data):
    a = sorted((r.doc_id or -1, r.ids_sha256) for r in P.run(spark, data).collect())
    b = sorted((r.doc_id or -1, r.ids_sha256) for r in P.run(spark, data).collect())
    assert a == b and a


def test_mixing_shuffles_no_text(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i if i % 7 else None, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 30))), f"l{i % 2}", f"src{i % 3}", i) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")  # less than the keys of all rows that are left out
    try:
        out = P.mix_sources(spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.n for r in out.collect())
    finally:
        spark.conf.set(name, before)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert set(got) == brute_mix([(n, i, t, lang, source) for i, t, lang, source, n in rows], P.MIX["fraction"], mixing.WEIGHTS)
    assert len(got) == len(set(got))


def test_mixing_cuts_among_equal_rows(spark):
    rows = [(1, "a b", "en", "src0")] * 301 + [(None, "c d", "en", "src0")] * 100 + [(2, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    scratch = Scratch(spark, "t")
    keys, key = keyed(docs, scratch, repeatable=True)
    for epochs, fraction in ((1, (1, 2)), (1, (1, 1)), (2, (3, 2)), (1, (0, 1))):
        kept = mixing.selected(keys, key, scratch, fraction, epochs)
        read = mixing.mix(docs, scratch, fraction, epochs).filter("copies > 0")
        assert kept.columns == keys.columns
        assert sorted(kept.groupBy("doc_id").count().collect(), key=str) == sorted(read.groupBy("doc_id").count().collect(), key=str)
        assert kept.count() == read.count() == {(1, 2): 201, (1, 1): 401, (3, 2): 401, (0, 1): 0}[fraction]
