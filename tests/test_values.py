"""Values of the queries that SQL can't express, against plain Python over the same tables."""

import collections
import functools
import hashlib
import re

import numpy as np
import pytest

from compare import duck
from weftline import catalogue
from weftline.functions import text as TEXT
from weftline.operators import causal_graph, models, series

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: catalogue.queries()[name](spark, SF).collect()


def sql(text, folder=SF):
    return duck(folder).sql(text).fetchall()


@pytest.fixture(scope="module")
def rates():
    """Six-hour counts of each type, dense."""
    rows = sql("SELECT event_type, epoch_us(ts) / 1e6 FROM events")
    t0, t1 = min(t for _, t in rows), max(t for _, t in rows)
    out = {k: np.zeros(int(np.ceil((t1 - t0) / 21600)) + 1) for k, _ in rows}
    for k, t in rows:
        out[k][int((t - t0) // 21600)] += 1
    return out


def divisive(lines, similar=0.4):
    """Template of each different list of words, a group at a time."""
    groups, out = collections.defaultdict(list), {}
    for w in {tuple(x) for x in lines}:
        groups[len(w), w[:2]].append(w)
    todo = list(groups.values())
    while todo:
        g = todo.pop()
        kinds = [len(set(c)) for c in zip(*g)]
        if sum(k == 1 for k in kinds) / len(kinds) >= similar or max(kinds) == 1:
            made = " ".join(c[0] if len(set(c)) == 1 and not re.fullmatch("<[A-Z]+>", c[0]) else "<*>" for c in zip(*g))
            out |= dict.fromkeys(g, made)
            continue
        at = min((k, i) for i, k in enumerate(kinds) if k > 1)[1]
        parts = collections.defaultdict(list)
        for w in g:
            parts[w[at]].append(w)
        todo += parts.values()
    return out


def test_template_mining(run):
    masks = [(re.compile(p), m) for p, m in TEXT.MASKS]
    lines = []
    for (text,) in sql("SELECT text FROM conversations"):
        for line in (text or "").split("\n"):
            if line:
                for p, m in masks:
                    line = p.sub(m, line)
                lines.append(tuple(re.split(r"\s+", line.strip())))
    made = divisive(lines)
    want = collections.Counter(made[w] for w in lines)
    assert {r.template: r.hits for r in run("template_mining")} == want
    top = sorted(want.items(), key=lambda t: (-t[1], t[0]))[:10]
    assert [(r.template, r.hits, r["rank"]) for r in sorted(run("busiest_templates"), key=lambda r: r["rank"])] == [(*t, i + 1) for i, t in enumerate(top)]


def test_templates_keep_their_likeness(spark):
    from weftline.operators import mining

    lines = ["alpha beta ca da ea fa ga ha ia ja", "alpha beta cb db eb fb gb hb ib jb"]
    name = "stuvwxyz"
    lines += [f"job run a{name[i % 2]} x{c} y{c} z{c} w{c} v{c} same q{c}" for i, c in enumerate(name)]
    lines += [f"disk sda{i} failed at sector {i * 7} on host h{i}" for i in range(5)]
    for order in (lines, lines[::-1]):
        got = mining.templates(spark.createDataFrame([(x,) for x in order], "message string")).collect()
        mask = lambda x: functools.reduce(lambda s, m: re.sub(m[0], m[1], s), TEXT.MASKS, x)
        plain = divisive([tuple(mask(x).split()) for x in lines])
        assert {r.message: r.template for r in got} == {x: plain[tuple(mask(x).split())] for x in lines}
        assert len({r.template for r in got if r.message.startswith("alpha")}) == 2
    assert mining.templates(spark.createDataFrame([(None,), ("",), ("",)], "message string")).count() == 2


def test_merging_in_rounds_equals_the_list(spark):
    import random

    from weftline.operators import mining

    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 7))) for _ in range(60)})
    rows = [(n, rnd.randint(10, 20)) for n in names]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, last = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(last[j + 1] + 1, d[j] + 1, last[j] + (x != y)))
        return d[-1]

    want, ranked = {}, sorted(rows, key=lambda r: (-r[1], r[0]))
    for i, (a, _) in enumerate(ranked):
        if a not in want:
            want |= {b: a for b, _ in ranked[i + 1:] if b not in want and distance(a, b) <= 2}
    got = mining.merge_templates(spark.createDataFrame(rows, "template string, hits long"))
    assert {r.template: r.survivor for r in got.collect()} == want and len(want) > 20


def test_causal_tests_and_graph(run, rates):
    got = {(r.src, r.dst): (r.granger_p, r.te_z) for r in run("causal_tests")}
    assert len(got) == len(rates) * (len(rates) - 1)
    for (a, b), (p, z) in got.items():
        assert (p, z) == pytest.approx((series.granger(rates[a], rates[b]), series.transfer_entropy_z(rates[a], rates[b])))
    names = sorted(rates)
    g = causal_graph.pc(names, np.round(np.corrcoef([rates[n] for n in names]), 12), len(rates[names[0]]))
    edges = {(r.u, r.v, r.directed) for r in run("causal_graph")}
    assert edges == {(u, v, True) for u, v in g.directed} | {(u, v, False) for u, v in g.undirected}


def test_multimodal_graph(run):
    series_ = collections.defaultdict(dict)
    for r in run("multimodal_series"):
        series_[r.node][r.bin] = r.n
    names = sorted(series_)
    assert {n.split(":")[0] for n in names} == {"log", "metric", "span"}
    x = [[series_[n][b] for b in sorted(series_[n])] for n in names]
    g = causal_graph.pc(names, np.corrcoef(x), len(x[0]))
    edges = {(r.u, r.v, r.directed) for r in run("multimodal_graph")}
    assert edges == {(u, v, True) for u, v in g.directed} | {(u, v, False) for u, v in g.undirected}


def test_causal_candidates(spark):
    larger = "/root/testdata/sf0.01"
    run = lambda name: catalogue.queries()[name](spark, larger).collect()
    edges = {(r.src, r.dst): r for r in run("directed_edges") if r.directed}
    rows = sql("SELECT event_type, 'user:u' || user_id, epoch_us(ts) / 1e6 FROM events", larger)
    ends = {x for e in edges for x in e}
    times = collections.defaultdict(list)
    for k, u, t in rows:
        for x in {k, u} & ends:
            times[x].append(t)
    t0, t1 = (f(t for v in times.values() for t in v) for f in (min, max)) if times else (0, 0)
    count = lambda x: np.bincount(((np.array(times[x]) - t0) // 21600).astype(int), minlength=int(np.ceil((t1 - t0) / 21600)) + 1).astype(float)
    want = {}
    for (a, b), e in edges.items():
        p, z = series.granger(count(a), count(b)), series.transfer_entropy_z(count(a), count(b))
        via = "granger" if p < 0.05 else "transfer-entropy" if z > 2 else None
        if via:
            stat = 1 - p / 0.05 if via == "granger" else min(1, z / 4)
            want[a, b] = via, min(1, 0.4 * min(1, (e.pmi - 2) / 8) + 0.3 * (e.lead - 0.7) / 0.3 + 0.3 * stat)
    got = {(r.src, r.dst): (r.via, r.confidence) for r in run("causal_candidates")}
    assert got.keys() == want.keys() and got
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in got)


def test_trajectory_scores(run):
    rows = sql("SELECT user_id, CAST(ts AS DATE), event_type FROM events ORDER BY user_id, CAST(ts AS DATE), ts, event_id, event_type")
    seqs = collections.defaultdict(list)
    for u, d, k in rows:
        if not seqs[u, d] or seqs[u, d][-1] != k:
            seqs[u, d].append(k)
    traj = {(f"cohort{u % 8}", f"{u}|{d}"): q for (u, d), q in seqs.items() if len(q) >= 4}
    got = {(r.service, r.trace): r for r in run("trajectory_scores")}
    assert got.keys() == traj.keys() and got
    n = collections.Counter(s for s, _ in traj)
    held = collections.Counter((s, k) for (s, _), q in traj.items() for k in set(q))
    for (s, t), q in traj.items():
        rate = {k: held[s, k] / n[s] for (x, k) in held if x == s}
        common = {k for k, r in rate.items() if r >= 0.5}
        novel = [k for k in set(q) if rate[k] < 0.3]
        bag = (len(common - set(q)) + len(novel)) / max(1, len(common))
        r = got[s, t]
        assert (r.steps, r.novelty, r.score) == pytest.approx((len(q), bag, r.per_step - 2 * bag))
        assert rate[r.change] == min(rate[k] for k in q) and q.index(r.change) == r.change_at
        assert r.per_step < 0 if r.states else r.per_step == 0
        assert r.confidence >= (0.6 if novel else 0.5 if common - set(q) else 0) and r.confidence <= 1
    flagged = [r.score for r in got.values() if r.anomalous]
    assert len(flagged) == max(1, int(len(got) * 0.05))
    assert max(flagged) <= min(r.score for r in got.values() if not r.anomalous)


def test_gp_rate_anomalies(run):
    hourly = collections.defaultdict(list)
    for k, d, h, n in sql("SELECT event_type, CAST(ts AS DATE), hour(ts), count(*) FROM events GROUP BY 1, 2, 3 ORDER BY 1, 2, 3"):
        hourly[k].append((d.toordinal() * 24.0 + h, n))
    got = collections.defaultdict(list)
    for r in sorted(run("gp_rate_anomalies"), key=lambda r: (r.cluster, r.day, r.hour)):
        got[r.cluster].append((r.expected, r.z))
    for k, points in hourly.items():
        x, y = np.array(points).T
        fit = models.gp_baseline(x - x[0], y, x - x[0])
        r = y - fit
        z = (r - np.median(r)) / max(1.4826 * np.median(np.abs(r - np.median(r))), 0.5)
        assert np.allclose(np.array(got[k], float), np.column_stack([fit, z]), atol=1e-6)


def test_hash_embeddings(run):
    texts = dict(sql("SELECT item_id, text FROM benchmark"))
    for r in run("hash_embeddings"):
        v = np.zeros(384)
        for t in re.findall("[a-z0-9_]{2,}", texts[r.item_id].lower()):
            d = hashlib.sha256(t.encode()).digest()
            for i in range(4):
                v[int.from_bytes(d[8 * i : 8 * i + 4], "big") % 384] += 1 if d[8 * i + 4] & 1 else -1
        assert np.allclose(r.v, v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_owl_closure(run):
    nation = dict(sql("SELECT n_nationkey, n_regionkey FROM nation"))
    supplier = dict(sql("SELECT s_suppkey, s_nationkey FROM supplier"))
    want = {("Supplier", "rdfs:subClassOf", "Thing")}
    for s, n in supplier.items():
        want |= {(f"supplier/{s}", "rdf:type", c) for c in ("Party", "Thing")}
        want |= {(f"supplier/{s}", "in", f"region/{nation[n]}"), (f"nation/{n}", "rdf:type", "Place")}
    want |= {(f"region/{r}", "rdf:type", "Place") for r in nation.values()}
    assert {(r.s, r.p, r.o) for r in run("owl_closure")} == want


def test_template_embedding(run):
    words = lambda t: set(re.findall("[a-z_]{2,}", t))
    names = {f"{t} {b}".lower() for t, b in sql("SELECT p_type, p_brand FROM part")}
    got = run("template_embedding")
    assert got and all(r.a < r.b and {r.a, r.b} <= names and -1e-9 <= r.distance <= 0.25 for r in got)
    pairs = {(r.a, r.b) for r in got}
    assert all((a, b) in pairs for a in names for b in names if a < b and words(a) == words(b))


def test_review_ranking(run):
    quality = dict(sql("SELECT doc_id, quality FROM labels"))
    got = {r.doc_id: r.chance for r in run("review_ranking")}
    assert got.keys() == quality.keys() and all(0 <= c <= 1 for c in got.values())
    mean = lambda y: np.mean([c for i, c in got.items() if quality[i] == y])
    assert mean(1) > mean(0)


def test_graphql_types(run):
    got = {r.table_name: r.definition for r in run("graphql_types")}
    assert set(got) >= {"region", "nation", "orders", "events"}
    assert got["region"].startswith("type Region {\n") and "r_regionkey: Int" in got["region"] and "r_name: String" in got["region"]
    assert "o_totalprice: Float" in got["orders"] and got["orders"].endswith("\n}")


def cohorts():
    """(service, trace) -> symbols of each user's day."""
    rows = sql("SELECT user_id, CAST(ts AS DATE), event_type FROM events ORDER BY user_id, CAST(ts AS DATE), ts, event_id, event_type")
    seqs = collections.defaultdict(list)
    for u, d, k in rows:
        if not seqs[u, d] or seqs[u, d][-1] != k:
            seqs[u, d].append(k)
    return {(f"cohort{u % 8}", f"{u}|{d}"): q for (u, d), q in seqs.items() if len(q) >= 4}


def modelled(traj, least):
    """Services with enough trajectories, steps and symbols for a model."""
    by = collections.defaultdict(list)
    for (s, _), q in traj.items():
        by[s].append(q)
    return {s for s, v in by.items() if len(v) >= least and sum(map(len, v)) >= 12 and len({x for q in v for x in q}) >= 2}


def test_regime_anomalies(run):
    traj = cohorts()
    got = {(r.service, r.trace): r for r in run("regime_anomalies")}
    some = modelled(traj, 4)
    assert got.keys() == {k for k in traj if k[0] in some} and got
    limits = {(r.service, r.regime): r.threshold for r in got.values()}
    for key, limit in limits.items():
        steps = [r.per_step for r in got.values() if (r.service, r.regime) == key]
        assert limit == pytest.approx(np.percentile(steps, 5))
    for (s, t), r in got.items():
        q = traj[s, t]
        assert r.anomalous == (r.per_step < r.threshold) and (r.confidence is None) == (not r.anomalous)
        assert q[r.change_at] == r.change and q.index(r.change) == r.change_at and 0 < r.posterior <= 1 and r.per_step < 0


def test_global_regimes(run):
    traj = cohorts()
    got = sorted(run("global_regimes"), key=lambda r: r.window)
    by = collections.Counter(s for s, _ in traj)
    want = {w: sorted({s for s, n in by.items() for i in range(n) if min(7, i * 8 // n) == w}) for w in range(8)}
    assert [(r.window, r.services) for r in got] == [(w, want[w]) for w in range(8)]
    assert all(r.global_regime in (0, 1) and r.log_likelihood < 0 for r in got)


def test_variational_confidence(run):
    traj = cohorts()
    got = {(r.service, r.trace): r for r in run("variational_confidence")}
    some = modelled(traj, 1)
    assert got.keys() == {k for k in traj if k[0] in some} and got
    for s in some:
        mine = [r for r in got.values() if r.service == s]
        (limit,) = {r.threshold for r in mine}
        assert limit == pytest.approx(np.percentile([r.per_step for r in mine], 5))
        assert all(0 <= r.confidence <= 1 and (r.confidence > 0.5) == (r.per_step < r.threshold) for r in mine if r.deviation > 1e-9 and r.per_step != r.threshold)


def test_interventional_graph(run):
    before = {(r.u, r.v, r.directed) for r in run("causal_graph")}
    after = {(r.u, r.v, r.directed) for r in run("interventional_graph")}
    assert {frozenset(e[:2]) for e in before} == {frozenset(e[:2]) for e in after}
    set_ = sorted({k for (k,) in sql("SELECT DISTINCT event_type FROM events")})[:2]
    assert all(d for u, v, d in after if {u, v} & set(set_))
    assert {e for e in before if e[2]} <= after


def test_refitted_detector(run):
    counts = sql("SELECT event_type, CAST(hour(ts) AS INT), CAST(ts AS DATE), count(*) FROM events GROUP BY 1, 2, 3")
    got = {(r.cluster, r.hour, r.day): r for r in run("refitted_detector")}
    assert got.keys() == {(c, h, d) for c, h, d, _ in counts} and {r.batch for r in got.values()} == {0, 1, 2}
    first = min(d for _, _, d, _ in counts)
    for c, h, d, n in counts:
        r = got[c, h, d]
        part = min((d.day - 1) // 10, 2)
        # later batches stand on fits of those before; the first on plain medians
        assert r.n == n and r.batch == part and (r.via == "gp") == (part > 0) and r.z == pytest.approx((n - r.expected) / r.sd)
        if part == 0:
            past = [k for x, y, e, k in sorted(counts, key=lambda q: q[2]) if (x, y) == (c, h) and first <= e < d][-30:]
            assert r.expected == pytest.approx(float(np.median(past)) if past else 0.0)


def test_attention_scores(run):
    got = run("attention_scores")
    days = sql("""SELECT 'cohort' || user_id % 8 AS s, user_id || '|' || CAST(ts AS DATE) AS t, list(event_type ORDER BY ts, event_type, event_id) FROM events GROUP BY 1, 2""")
    walks = {}
    for s, t, types in days:
        q = [x for i, x in enumerate(types) if not i or types[i - 1] != x]
        if len(q) >= 4:
            walks[s, t] = q
    fitted = {s for s in {k[0] for k in walks} if sum(len(q) for k, q in walks.items() if k[0] == s) >= 12}
    assert got and {(r.service, r.trace) for r in got} == {k for k in walks if k[0] in fitted}
    kinds = {s: len({x for k, q in walks.items() if k[0] == s for x in q}) for s in fitted}
    for r in got:
        q = walks[r.service, r.trace]
        assert r.per_step < 0 and q[r.surprise_at] == r.surprise
        if r.surprise_at > 1:
            assert r.attended_at < r.surprise_at - 1 and q[r.attended_at] == r.attended and 0 <= r.weight <= 1
        else:
            assert r.attended_at is None and r.attended is None
    for s in fitted:  # what is learnt beats a guess
        mine = [(r.per_step, len(walks[s, r.trace]) - 1) for r in got if r.service == s]
        assert sum(p * n for p, n in mine) / sum(n for _, n in mine) > -np.log(kinds[s])
