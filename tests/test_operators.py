"""Operators on hand-made inputs with known answers."""

import itertools
import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.vector import cosine, hash_embedding
from weftline.operators import causal_graph, gates, graph, mining, range_join, ranks, sequences, series, vectors
from weftline.sources import logs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_jsonl_skips_empty_keys(spark):
    raw = json.dumps({"timestamp": "", "time": "2024-01-01", "msg": "hi", "level": "error", "app": "amf", "count": 3})
    r = logs.parse(spark.createDataFrame([(raw,)], "raw string"), "jsonl").first()
    assert (r.timestamp, r.message, r.severity, r.app, r.value, r.confidence) == ("2024-01-01", "hi", "ERROR", "amf", 3.0, 0.85)


def test_syslog_cef_otlp_auto(spark):
    lines = [
        "<34>1 2024-01-01T00:00:00Z host1 app1 77 ID1 failed login", "Jan  1 00:00:00 h2 cron[12]: started", "no format at all", "  ",
        "Jan 1 x CEF:0|v|prod|1|100|worm stopped|9|rt=today src=10.0.0.1 shost=box a dhost=box b", "CEF: broken", '{"broken": ',
        json.dumps({"traceId": "1", "kind": 3, "startTimeUnixNano": "1000000", "endTimeUnixNano": "4000000"}),
    ]
    got = logs.parse(spark.createDataFrame([(x,) for x in lines], "raw string").coalesce(1)).collect()
    assert [r.format for r in got] == ["syslog", "syslog", "syslog", "cef", "otlp"]
    assert (got[0].severity, got[0].host, got[0].message, got[0].confidence) == ("2", "host1", "failed login", 0.95)
    assert (got[1].app, got[1].pid, got[1].message, got[1].confidence) == ("cron", "12", "started", 0.55)
    assert got[2].confidence == 0.4 and got[2].message == "no format at all"
    assert (got[3].timestamp, got[3].host, got[3].severity, got[3].confidence) == ("today", "box b", "9", 1.0)
    assert got[3].fields["shost"] == "box a"
    assert (got[4].value, got[4].unit, got[4].message) == (3.0, "ms", "3")
    routed = logs.route(logs.parse(spark.createDataFrame([(x,) for x in lines], "raw string").coalesce(1)), ["cron", "started"])
    assert [r.route for r in routed.collect()] == ["event", "observation", "rejected", "rejected", "observation"]


def test_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, n in (("a/x.log", 700), ("y.jsonl", 3), ("z.bin", 5)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 703 and all(r.raw == f"line {r.line_no}" for r in got)


def test_custom_pattern_and_extension(spark):
    df = spark.createDataFrame([("user=bob code=7",)], "raw string")
    assert df.select(logs.parse_pattern(F.col("raw"), r"user=(?P<user>\w+) code=(?P<code>\d+)").alias("m")).first().m == {"user": "bob", "code": "7"}
    got = logs.parse(df, "regex", pattern=r"user=(?P<message>\w+) code=(?P<code>\d+)").first()
    assert (got.message, got.severity, got.confidence, got.fields["code"]) == ("bob", "INFO", 0.6, "7")


def test_text_functions(spark):
    assert one(spark, T.mask(F.lit("at 2024-01-01T00:00:00Z 10.1.2.3 took 55 ms 0xff"))) == "at <TS> <IP> took <NUM> ms <HEX>"
    assert one(spark, T.clean_line(F.lit("2024-01-01 00:00:00 ERROR disk sda1 failing badly"))) == "disk sda<NUM> failing badly"
    assert one(spark, T.clean_line(F.lit("INFO ok"))) is None
    assert one(spark, T.camel_case(F.lit("domain_event_log"))) == "DomainEventLog"
    assert one(spark, T.normal_name(F.lit("hasSerial_No"))) == "serialno"
    assert one(spark, T.local_name(F.lit("LINK DOWN_minor"))) == "LinkDownMinor"
    assert one(spark, T.uuid5(uuid.NAMESPACE_URL.hex, F.lit("a|b"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b"))
    assert [one(spark, T.to_boolean(F.lit(v))) for v in ("Yes", "t", "0", "maybe")] == [True, True, False, False]
    assert one(spark, T.typed_literal(F.lit("12"), F.lit("xsd:integer"))) == '"12"^^<http://www.w3.org/2001/XMLSchema#integer>'
    assert one(spark, T.typed_literal(F.lit('x"y'), F.lit("xsd:integer"))) == '"x\\"y"'
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, cosine(a, F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    v = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "t array<string>").select(hash_embedding()(F.col("t")).alias("v")).collect()
    assert np.linalg.norm(v[0].v) == pytest.approx(1) and len(v[0].v) == 384 and not any(v[1].v) and not any(v[2].v)
    with pytest.raises(ValueError):
        vectors.allowed(spark.range(1), "Secret")


def test_band_join_finds_all_pairs(spark):
    rows = [(i, i % 2, float(x)) for i, x in enumerate([0, 9, 10, 19, 21, 300, -5])]
    df = spark.createDataFrame(rows, "id int, k int, at double")
    got = {(r.id, r.r_id) for r in range_join.band_join(df, df, ["k"], "at", 10.0).collect()}
    assert got == {(a, b) for a, ka, x in rows for b, kb, y in rows if ka == kb and abs(x - y) < 10}


def test_pmi_and_direction(spark):
    rows = [(f"t{i}", e, i * 1000.0 + d) for i in range(10) for e, d in (("A", 0), ("B", 10))] + [(f"n{i}", "C", 90000.0 + i * 500) for i in range(5)]
    r = spark.createDataFrame(rows, "trace string, entity string, at double")
    lead = mining.lead_ratio(r, 60.0).collect()
    assert [(x.src, x.dst, x.lead, x.direction) for x in lead] == [("A", "B", 1.0, "forward")]
    m = r.groupBy("entity").agg(F.count("*").cast("double").alias("c"))
    edge = mining.pmi(mining.trace_pairs(r), m, m.agg(F.sum("c").alias("n")), 0).first()
    assert edge.pmi == pytest.approx(math.log2((10 / 25) / ((10 / 25) ** 2)), abs=1e-6)


def test_templates_are_order_independent(spark):
    lines = [f"link {i} down on port {i * 7}" for i in range(5)] + ["all quiet here now"]
    a = {r.template for r in mining.templates(spark.createDataFrame([(x,) for x in lines], "message string")).collect()}
    b = {r.template for r in mining.templates(spark.createDataFrame([(x,) for x in lines[::-1]], "message string")).collect()}
    assert a == b == {"link <*> down on port <*>", "all quiet here now"}
    slots = mining.templates(spark.createDataFrame([(x,) for x in lines], "message string")).filter("template like 'link%'").first().slots
    assert len(slots) == 2


def test_merge_templates(spark):
    c = spark.createDataFrame([("a b c", 50), ("a b d", 20), ("x y z w", 30), ("a b e", 3)], "template string, hits long")
    assert {tuple(r) for r in mining.merge_templates(c).collect()} == {("a b d", "a b c")}


def test_f_tail_and_causality():
    assert series.f_tail(4.0, 2, 20) == pytest.approx(0.034571, abs=1e-4)
    rng = np.random.RandomState(0)
    x = rng.normal(size=300)
    y = np.concatenate([[0], 0.9 * x[:-1]]) + 0.1 * rng.normal(size=300)
    assert series.granger(x, y) < 1e-6 < 0.01 < series.granger(y, rng.normal(size=300))
    assert series.transfer_entropy_z(x, y) > 2 > series.transfer_entropy_z(rng.normal(size=300), y) - 1.5
    assert series.granger(x[:10], y[:10]) == 1.0


def test_causal_gate(spark):
    edges = spark.createDataFrame(
        [("a", "b", 6.0, 0.85), ("c", "d", 12.0, 1.0), ("e", "f", 9.0, 0.9), ("g", "h", 1.9, 0.9), ("i", "j", 5.0, 0.6)],
        "src string, dst string, pmi double, lead double")
    tests = spark.createDataFrame(
        [("a", "b", 0.01, 9.0), ("c", "d", 0.2, 3.0), ("e", "f", 0.2, 2.0), ("g", "h", 0.0, 9.0), ("i", "j", 0.0, 9.0)],
        "src string, dst string, granger_p double, te_z double")
    got = {r.src: (r.via, r.confidence) for r in series.causal_gate(edges, tests).collect()}
    assert got == {"a": ("granger", pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.3 * 0.8)), "c": ("transfer-entropy", pytest.approx(0.4 + 0.3 + 0.3 * 0.75))}


def test_guards_and_text_helpers(spark):
    from weftline.sources import tables

    df = spark.createDataFrame([("x_y", 1), ("x_y", 2), ("b-c", None)], "name string, n int")
    assert gates.limited(df, 2).count() == 2 and gates.limited(df).count() == 3
    assert {r.name for r in tables.probe(df, "name").collect()} == {"x_y", "b-c"}
    assert [r.t for r in df.orderBy("name").select(T.label(F.col("name")).alias("t")).distinct().orderBy("t").collect()] == ["B C", "X Y"]
    assert {r.t for r in df.select(T.row_text("Thing", name=F.col("name"), n=F.col("n")).alias("t")).collect()} == {
        "class: Thing | name: x_y | n: 1", "class: Thing | name: x_y | n: 2", "class: Thing | name: b-c"}
    long = "LINK" + "a" * 3000
    assert one(spark, T.local_name(F.lit(f"{long} DOWN"))) == f"{long}Down"
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c")], "s string, p string, o string")
    made = graph.construct(t, [("?x", "p", "?y"), ("?y", "q", "?z")], ("?x", "r", "?z"))
    assert graph.explain(made, "a", "r", "c").first().bindings == {"x": "a", "y": "b", "z": "c"}
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("y", "x")], "sub string, sup string")
    assert {r.cls for r in graph.subclasses(tree, ["b"]).collect()} == {"a", "b", "c", "d"}
    assert {r.cls for r in graph.subclasses(tree, []).collect()} == set()


def test_seeding_ranking_and_merging(spark):
    from weftline.operators import review

    templates = spark.createDataFrame([("1", 10, "ERROR"), ("2", 2, "INFO"), ("3", 100, None)], "cluster_id string, hits long, severity string")
    slots = spark.createDataFrame([("1", 0, "IRI", 40, True), ("1", 1, "NUMERIC", 40, False)], "cluster_id string, slot int, slot_type string, n long, pii_risk boolean")
    edges = spark.createDataFrame([("a", "b", 5.0, 60, True), ("c", "d", 4.0, 3, True), ("e", "f", 2.9, 9, False)], "src string, dst string, pmi double, cooc long, directed boolean")
    causal = spark.createDataFrame([("a", "b", 0.7, 0.01)], "src string, dst string, confidence double, granger_p double")
    got = {(r.proposal_type, r.name): r for r in review.seed(templates, slots, edges, causal).collect()}
    assert set(got) == {("LOG_EVENT", "cluster:1"), ("LOG_EVENT", "cluster:3"), ("LOG_ENTITY", "1:0:IRI"), ("LOG_CAUSAL_EDGE", "a::b"), ("LOG_RELATIONSHIP", "c::d")}
    row = lambda *k: tuple(got[k][c] for c in review.SEED[3:])
    assert row("LOG_EVENT", "cluster:1") == pytest.approx((0.9, 0.2, 0.8, 0, 0)) and row("LOG_EVENT", "cluster:3") == pytest.approx((1, 1, 0.3, 0, 0))
    assert row("LOG_ENTITY", "1:0:IRI") == pytest.approx((0.7, 1, 0, 0, 0.8))
    assert row("LOG_CAUSAL_EDGE", "a::b") == pytest.approx((0.7, 1, 0, 0.5, 0.99)) and row("LOG_RELATIONSHIP", "c::d") == pytest.approx((0.5, 0.1, 0, 0.4, 0))
    assert len({r.proposal_id for r in got.values()}) == 5
    top = [r.name for r in review.candidates(review.seed(templates, slots, edges, causal), 2).collect()]
    assert top == ["cluster:1", "cluster:3"]  # 0.9 * 1.8 before 1.0 * 1.3
    queue = spark.createDataFrame([("p", "open", "x"), ("q", "open", "y"), ("r", "open", "z")], "proposal_id string, status string, evidence string")
    session = spark.createDataFrame([("known", ["old"])], "name string, samples array<string>")
    merges = spark.createDataFrame([("p", "known"), ("q", "unknown")], "proposal_id string, into string")
    after, entries = review.merge(queue, session, merges)
    assert sorted((r.proposal_id, r.status, r.note) for r in after.collect()) == [
        ("p", "approved", "merged-into:known"), ("q", "approved", None), ("r", "open", None)]
    assert [tuple(r) for r in entries.collect()] == [("known", ["old", "x"])]


def test_search_and_pairs_in_blocks(spark):
    from weftline.operators import models

    rng = np.random.RandomState(4)
    v = rng.normal(size=(50, 6)).round(3)
    recs = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    qs = recs.filter("vec_id < 20").selectExpr("vec_id as qid", "embedding as q", "label as qlabel")
    rows = lambda n: sorted(tuple(r) for r in vectors.search_many(recs, qs, 4, n).collect())
    assert rows(7) == rows(1000) and len(rows(7)) == 80
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ts = spark.createDataFrame([(f"t{i:02d}", x.tolist()) for i, x in enumerate(unit)], "template string, v array<double>")
    want = {(f"t{i:02d}", f"t{j:02d}") for i in range(50) for j in range(i + 1, 50) if 1 - unit[i] @ unit[j] <= 0.4}
    assert {(r.a, r.b) for r in models.nearest_templates(ts, 0.4, 9).collect()} == want and want


def test_pc_finds_collider_and_chain():
    rng = np.random.RandomState(2)
    a, b = rng.normal(size=2000), rng.normal(size=2000)
    c = a + b + 0.3 * rng.normal(size=2000)
    d = c + 0.3 * rng.normal(size=2000)
    g = causal_graph.pc(list("abcd"), np.corrcoef([a, b, c, d]), 2000)
    assert g.directed == {("a", "c"), ("b", "c"), ("c", "d")} and not g.undirected
    assert not causal_graph.pc(["a", "b"], np.eye(2), 10).directed
    h, conflicts = causal_graph.intervene(causal_graph.Pdag("xy", (), [("x", "y")]), "y")
    assert h.directed == {("y", "x")} and conflicts == []


def test_hmm_prefers_its_own_data():
    rng = np.random.RandomState(0)
    normal = [np.array([0, 1] * 6) for _ in range(20)]
    fit, _, k = sequences.choose_hmm(normal, 3)
    score = lambda q: sequences.log_likelihood(np.array(q), *fit[:3]) / len(q)
    assert score([0, 1] * 5) > score(list(rng.randint(0, 3, 10))) and k >= 2
    assert sequences.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-8)
    bound = [sequences.fit_vb_hmm(normal, s, 3)[3] for s in (1, 2)]
    assert bound[1] > bound[0]


def test_batched_recursions_equal_single_ones():
    rng = np.random.RandomState(5)
    seqs = [rng.randint(0, 4, k) for k in (1, 2, 5, 5, 9)]
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3)
    x, n = sequences.padded(seqs)
    want = [sequences.log_likelihood(q, start, move, emit) for q in seqs]
    assert np.allclose(sequences.log_likelihoods(x, n, start, move, emit), want)
    s, m, e, ll = sequences._expected(x, n, start, move, emit)
    # brute force over all paths of states
    bs, bm, be = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for q in seqs[:4]:
        paths = [(p, start[p[0]] * np.prod([move[a, b] for a, b in zip(p, p[1:])]) * np.prod([emit[a, o] for a, o in zip(p, q)]))
                 for p in itertools.product(range(3), repeat=len(q))]
        total = sum(w for _, w in paths)
        for p, w in paths:
            bs[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                bm[a, b] += w / total
            for a, o in zip(p, q):
                be[a, o] += w / total
    s4, m4, e4, _ = sequences._expected(*sequences.padded(seqs[:4]), start, move, emit)
    assert np.allclose(s4, bs) and np.allclose(m4, bm) and np.allclose(e4, be)
    assert ll == pytest.approx(sum(want)) and s.sum() == pytest.approx(5) and e.sum() == pytest.approx(n.sum())
    sharp = (np.array([1e4, 1]), np.array([[1e4, 1], [1, 1e4]]), np.array([[1e4, 1], [1, 1e4]]))
    assert sequences.calibrated_confidence(np.array([0, 0, 0]), sharp, -5.0) < 0.01 < 0.99 < sequences.calibrated_confidence(np.array([1, 1, 1]), sharp, -1.0)


def test_ranks_and_percentiles(spark):
    rng = np.random.RandomState(1)
    data = [(k, float(v), i) for i, (k, v) in enumerate(zip(rng.choice(["a", "b"], 500), rng.randint(0, 60, 500)))]
    data += [("a", None, 1000), ("c", 1.0, 1001)]
    df = spark.createDataFrame(data, "k string, v double, id long")
    got = {(r.k, r.id): (r["rank"], r.n) for r in ranks.ranked(df, ["k"], "v", ["id"], bins=7).collect()}
    for key in "abc":
        order = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[key, r[2]] for r in order] == [(i, len(order)) for i in range(len(order))]
    p = {r.k: (r.mid, r.high) for r in ranks.percentiles(df, ["k"], "v", {"mid": 0.5, "high": 0.95}).collect()}
    for key in "ab":
        v = sorted(r[1] for r in data if r[0] == key and r[1] is not None)
        assert p[key] == tuple(v[int(s * (len(v) - 1) + 0.5)] for s in (0.5, 0.95))
    assert ranks.ranked(df.limit(0), ["k"], "v").count() == 0
    assert [r.low for r in ranks.lowest(df.filter("k = 'c'"), "v", ["id"], 0.05).collect()] == [True]


def test_injected_outlier_is_flagged(spark):
    rows = [("s", f"t{i:03d}", ["up", "run", "idle", "run", "down"][: 4 + i % 2]) for i in range(60)]
    rows += [("s", "odd", ["up", "fail", "down", "fail"]), ("few", "x", ["a", "b"])]
    got = {r.trace: r for r in sequences.score_trajectories(
        spark.createDataFrame(rows, "service string, trace string, symbols array<string>"), "service").collect()}
    assert got["odd"].anomalous and got["odd"].confidence >= 0.6 and (got["odd"].change, got["odd"].change_at) == ("fail", 1)
    assert got["odd"].novelty == pytest.approx((2 + 1) / len([s for s in ("up", "run", "idle", "down")]))
    assert sum(r.anomalous for r in got.values()) == 3 and got["x"].states == 0 and got["x"].per_step == 0.0


def test_graph_patterns_and_fixpoint(spark):
    t = spark.createDataFrame([("a", "in", "b", True), ("b", "in", "c", True), ("c", "in", "a", True), ("a", "k", "1", False)],
                              "s string, p string, o string, o_is_iri boolean")
    assert graph.match(t, [("?x", "in", "?y"), ("?y", "in", "?z")]).count() == 3
    assert graph.match(t, [("?x", "in", "?x")]).count() == 0
    assert graph.closure(t.filter("p = 'in'"), "s", "o").count() == 9
    assert graph.cycles(t.filter("p = 'in'"), "s", "o").count() == 3
    rules = [("r1", ("p", ("?x", "?y")), [("e", ("?x", "?y"))]), ("r2", ("p", ("?x", "?z")), [("p", ("?x", "?y")), ("p", ("?y", "?z"))])]
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "a1 string, a2 string")
    assert graph.datalog({"e": e}, rules).filter("predicate = 'p'").count() == 15
    types = spark.createDataFrame([("x", "rdf:type", "A"), ("A", "rdfs:subClassOf", "B"), ("A", "owl:disjointWith", "B")], "s string, p string, o string")
    derived = graph.owl_closure(types)
    assert {(r.s, r.o) for r in derived.collect()} == {("x", "B")}
    both = types.unionByName(derived.select("s", "p", "o"))
    assert graph.inconsistencies(both).first().detail == "A|B"
    found = {(r.pitfall, r.element) for r in graph.pitfalls(spark.createDataFrame(
        [("A", "rdf:type", "owl:Class", True), ("p", "rdf:type", "owl:ObjectProperty", True)], "s string, p string, o string, o_is_iri boolean")).collect()}
    assert {("P04", "A"), ("P08", "A"), ("P08", "p"), ("P11", "p"), ("P13", "p")} <= found


def test_plan_fails_closed(spark):
    m = gates.Mapping({"C": "c"}, {"C": {"hasName": ("n", "Public"), "secret": ("s", "Restricted"), "odd": ("o", "Unknown")}})
    t = {"c": spark.createDataFrame([("x", 1, 2)], "n string, s int, o int")}
    assert gates.compile_plan(gates.Plan("C"), m, t, "Internal").columns == ["n"]
    assert gates.validate(gates.Plan("C", [("name", "~", 1), ("none", "=", 1)]), m) == ["unknown operator ~", "'C has no property none'"]
    for plan in (gates.Plan("C", [("secret", "=", 1)]), gates.Plan("C", show=["secret"])):
        with pytest.raises(PermissionError):
            gates.compile_plan(plan, m, t, "Internal")
    with pytest.raises(ValueError):
        gates.compile_plan(gates.Plan("C"), m, t, "Nope")
    with pytest.raises(PermissionError):
        gates.read_only(spark, "DROP TABLE IF EXISTS x")
    assert gates.read_only(spark, "SELECT 1 AS a").first().a == 1
    assert gates.deidentify(t["c"], ["n"]).first().n == gates.MASK


def test_policy_language(spark):
    df = spark.createDataFrame([("up", 0.9), ("down", 0.5), (None, None)], "status string, c double")
    hit = lambda p: df.select(gates.policy(p).alias("x")).collect()
    assert [r.x for r in hit("c >= 0.8 and status in (up, idle)")] == [True, False, False]
    assert [r.x for r in hit("status > 3")] == [False, False, False]
    assert [r.x for r in hit("status startswith do")] == [False, True, False]


def test_timed_query_is_cancelled(spark):
    slow = spark.range(1 << 34).selectExpr("sum(hash(id) % 7) AS s")
    with pytest.raises(TimeoutError):
        gates.timed(slow, 1.0)
    assert gates.timed(spark.range(3), 60)[2].id == 2


def test_rate_detector_matches_batch(spark, tmp_path):
    from weftline.streaming import rates

    rows = [("a", 3, d, 10 + d % 2) for d in range(20)] + [("a", 3, 20, 90)]
    df = spark.createDataFrame(rows, "cluster string, hour int, d int, n long").selectExpr(
        "cluster", "hour", "date_add(date'2024-01-01', d) AS day", "n")
    df.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = rates.detect_rates(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("rates").orderBy("day").collect()
    counts = [r[3] for r in rows]
    for i, r in enumerate(got):  # the batch form: median and MAD of up to 30 counts before
        past = np.array(counts[max(0, i - 30) : i])
        mid = float(np.median(past)) if i else 0.0
        sd = max(1.4826 * float(np.median(np.abs(past - mid))), 0.5) if i else 0.5
        assert (r.expected, r.sd, r.z) == pytest.approx((mid, sd, (counts[i] - mid) / sd))
        assert r.is_anomaly == (i >= 3 and abs(r.z) >= 2.576) and r.via == "median_mad"
    assert [r.direction for r in got] == ["normal"] * 20 + ["spike"]
    fit = {r.hour: r for r in rates.refit(df).collect()}
    assert len(fit) == 24 and 9 < fit[3].mu < 30 and fit[3].sd > 0
    again = rates.detect_rates(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), rates.refit(df))
    q = again.writeStream.format("memory").queryName("refitted").outputMode("update").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.via for r in spark.table("refitted").collect()} == {"gp"}
    hourly = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    rates.consolidate(hourly, f"{tmp_path}/fits", f"{tmp_path}/e").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/fits/fit-000000000").count() == 24


def test_tables_and_sinks(spark, tmp_path):
    from weftline.operators import catalog_rules, review, stores
    from weftline.sources import sinks, tables

    ddl = tables.import_ddl("""-- shop
CREATE TABLE IF NOT EXISTS public.orders (id BIGSERIAL PRIMARY KEY, customer_id INT NOT NULL REFERENCES customers(id),
  total NUMERIC(10, 2), note VARCHAR(20) DEFAULT 'a,b', CONSTRAINT fk FOREIGN KEY (shop_id) REFERENCES shops (id), shop_id INT);
CREATE TABLE [customers] (id int not null, created_at TIMESTAMPTZ, PRIMARY KEY (id));""")
    assert ddl["orders"]["key"] == ["id"] and ddl["orders"]["foreign"] == [("customer_id", "customers", "id"), ("shop_id", "shops", "id")]
    assert [f.dataType.simpleString() for f in tables.schema_of(ddl["orders"])] == ["bigint", "bigint", "decimal(10,2)", "string", "bigint"]
    cols = spark.createDataFrame([("orders", "customer_id"), ("orders", "shop_id"), ("customers", "id"), ("shop", "id")], "table_name string, column_name string")
    assert {(r.column_name, r.target, r.confidence) for r in tables.soft_keys(cols).collect()} == {("customer_id", "customers", 0.75), ("shop_id", "shop", 0.85)}
    assert tables.jdbc_options("postgresql://u:p@h:5432/db") == {
        "url": "jdbc:postgresql://h:5432/db", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    assert tables.jdbc_options("mssql://h/db")["url"] == "jdbc:sqlserver://h;databaseName=db"
    with pytest.raises(ValueError):
        tables.jdbc_options("nosuch://x")
    t = spark.createDataFrame([("a b", "p", 'x"y\nz', False)], "s string, p string, o string, o_is_iri boolean")
    assert sinks.n_triples(t).first().value == '<http://example.org/a_b> <http://example.org/p> "x\\"y\\nz" .'
    edge = spark.createDataFrame([("it's", "b", "leads to")], "src string, dst string, label string")
    assert sinks.cypher(edge).first().statement == "MERGE (a:Entity {id: 'it\\'s'}) MERGE (b:Entity {id: 'b'}) MERGE (a)-[:LEADS_TO]->(b);"
    store = stores.ParquetStore(spark, str(tmp_path / "v"), "vec_id long, embedding array<float>, tier string, cls string")
    rows = spark.createDataFrame([(1, [1.0, 0.0], "Public", "a"), (2, [0.0, 1.0], "Restricted", "b")], store.schema)
    store.upsert(rows)
    store.upsert(rows.filter("vec_id = 1"))
    assert store.count() == 2 and [r.vec_id for r in store.search([1.0, 0.1], 5, "Internal").collect()] == [1]
    other = stores.ParquetStore(spark, str(tmp_path / "v"), store.schema)  # another reader sees the last version
    assert other.count() == 2 and other.version() == 2
    store.delete(rows.filter("vec_id = 1"))
    assert store.count() == other.count() == 1
    assert stores.REGISTRY.make("store", "parquet", spark, str(tmp_path / "v"), store.schema).count() == 1
    with pytest.raises(KeyError):
        stores.REGISTRY.make("store", "none")
    prov = catalog_rules.provenance(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "iri string, source_ref string"))
    assert {r.iri: r.chain for r in prov.collect()} == {"a": ["a", "b"], "b": ["b", "a"], "c": ["c"]}
    q = spark.createDataFrame([("1", "open", "x"), ("2", "approved", "y")], "proposal_id string, status string, evidence string")
    f = spark.createDataFrame([("1", "n"), ("2", "n"), ("3", "n")], "proposal_id string, evidence string")
    assert sorted(tuple(r) for r in review.upsert(q, f).collect()) == [("1", "open", "n"), ("2", "approved", "y"), ("3", "open", "n")]


def test_models():
    from weftline.operators import models

    x = np.arange(0, 96.0)
    y = 10 + 5 * np.sin(2 * np.pi * x / 24)
    assert np.abs(models.gp_baseline(x, y, x) - y).max() < 0.5
    assert np.abs(models.sparse_gp(x, y, x, 40) - y).max() < 1.0


def test_gp_rates_fit_long_series_in_full(spark):
    import datetime

    from weftline.operators import models

    x = np.arange(0, 720.0)
    y = np.round(50 + 20 * np.sin(2 * np.pi * x / 24) + 15 * np.sin(2 * np.pi * x / 170))
    day = datetime.date(2024, 1, 1)
    rows = [("a", day + datetime.timedelta(int(i) // 24), int(i) % 24, int(n)) for i, n in zip(x, y)]
    hourly = spark.createDataFrame(rows, "cluster string, day date, hour int, n long")
    fits = {
        k: np.array([r.expected for r in models.gp_rates(hourly, "cluster", **k_args).orderBy("day", "hour").collect()])
        for k, k_args in (("full", {}), ("sparse", {"inducing": 48}))
    }
    assert np.abs(fits["full"] - models.gp_baseline(x, y, x)).max() < 1e-6
    assert np.abs(fits["sparse"] - models.sparse_gp(x, y, x, 48)).max() < 1e-6
    assert np.abs(fits["full"] - fits["sparse"]).max() > 1
