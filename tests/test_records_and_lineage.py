"""Provenance, tiers through derivations, depth with cycles, gates on neighbours and records, rules from a folder, small functions."""


import pytest

from weftline.functions import text as T
from weftline.operators import graph, lineage, mining, records, rule_folder, series, vectors
from weftline.sources import tables

P = records.Property


def test_tiers_follow_every_derivation(spark):
    edges = [("a", "b", "Public"), ("b", "d", "Public"), ("a", "c", "Confidential"), ("c", "d", "Internal"), ("d", "a", "Public"), ("x", "y", "Restricted")]
    e = spark.createDataFrame(edges, "a1 string, a2 string, tier string")
    rules = [("base", ("reach", ("?x", "?y")), [("e", ("?x", "?y"))]), ("step", ("reach", ("?x", "?z")), [("e", ("?x", "?y")), ("reach", ("?y", "?z"))])]
    derived = lineage.derivations(graph.datalog({"e": e.select("a1", "a2")}, rules), rules)
    two = derived.filter("predicate = 'reach' and args[0] = 'a' and args[1] = 'd'").collect()
    assert len(two) == 2 and {tuple(p.args) for r in two for p in r.premises} == {("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")}
    asserted = e.selectExpr("'e' as predicate", "array(a1, a2) as args", "tier")
    got = {(r.predicate, *r.args): r.tier for r in lineage.sensitivity(asserted, derived).collect()}
    # plain: greatest tier over the premises of all derivations, to the end
    rank = {t: i for i, t in enumerate(vectors.TIERS)}
    tier = {("e", a, b): rank[t] for a, b, t in edges}
    rows = [((r.predicate, *r.args), [(p.predicate, *p.args) for p in r.premises]) for r in derived.collect()]
    for _ in range(50):
        for head, premises in rows:
            tier[head] = max([tier.get(head, 0), *(tier.get(p, 0) for p in premises)])
    assert got == {k: vectors.TIERS[v] for k, v in tier.items()} and got["reach", "a", "d"] == "Confidential" and got["reach", "x", "y"] == "Restricted"


def test_children_with_weaker_tiers(spark):
    closed = spark.createDataFrame([("a", graph.SUB, "b"), ("b", graph.SUB, "c"), ("a", graph.SUB, "c"), ("a", graph.SUB, "a"), ("z", graph.SUB, "c")], "s string, p string, o string")
    tiers = spark.createDataFrame([("a", "Public"), ("b", "Restricted"), ("c", "Internal")], "cls string, tier string")
    assert {(r.child, r.parent) for r in lineage.weaker_children(closed, tiers).collect()} == {("a", "b"), ("a", "c")}


def test_depths_end_at_cycles(spark):
    edges = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("e", "a"), ("p", "q"), ("q", "p"), ("r", "q"), ("a", "a")]
    got = {r.node: r.depth for r in lineage.depths(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 2, "p": None, "q": None, "r": None}
    assert lineage.depths(spark.createDataFrame([], "child string, parent string")).count() == 0
    none = lineage.shape(spark.createDataFrame([], "s string, p string, o string")).first()
    assert none.classes == none.max_depth == none.cyclic == 0 and none.inheritance_richness == 0.0
    assert lineage.owl_profile(spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")).first().profile == "OWL 2 EL"


def test_individuals_make_nothing_up(spark):
    mapping = {
        "agent_id": P("by", "Internal", "Agent"), "created_at": P("made", "Public"), "valid_to": P("until", "Public"), "unit": P("unit", "Public"),
        "value": P("value", "Public"), "run_id": P("run", "Public", "Run"), "role": P("role", "Restricted"), "secret": P("secret", "Restricted"),
    }
    rows = [(1, "A b", "2024-01-01", None, "ms", "1.5", 7, "lead", "x"), (2, None, "2024-01-01", "2025-01-01", None, "2", None, None, "y"), (3, " ", None, "", "ms", "much", 1, "r", None), (None, "a", "t", "t", "u", "1", 1, "r", "z")]
    df = spark.createDataFrame(rows, "id long, agent_id string, created_at string, valid_to string, unit string, value string, run_id long, role string, secret string")
    of = lambda ceiling, events=("Run",): {(r.s, r.p, r.o): r.tier for r in records.individuals(df, "Obs", "id", mapping, ceiling, events).collect()}
    got = of("Internal")
    assert got["Obs/1", "prov:wasGeneratedBy", "ObsDerivation/1"] == "Internal" and got["ObsDerivation/1", "prov:wasAssociatedWith", "Agent/AB"] == "Internal"
    assert ("ObsQuantity/1", "numericValue", "1.5") in got and ("ObsValidity/2", "validUntil", "2025-01-01") in got and ("ObsValidity/2", "validFrom", "2025-01-01") not in got
    assert not any(s.startswith(("ObsDerivation/2", "ObsDerivation/3", "ObsQuantity/2", "ObsQuantity/3", "ObsValidity/1", "ObsValidity/3")) for s, _, _ in got)
    assert not any(p in ("secret", "role", "participationRole") or "unknown" in s for s, p, _ in got) and ("Obs/1", "participationIn", "Run/7") not in got
    every = of("Restricted")
    assert every["Obs/1", "participationRole", "lead"] == "Restricted" and ("Obs/2", "rdf:type", "Participation") not in every
    public = of("Public")
    assert not any("prov:" in p or "prov:" in o for _, p, o in public) and ("Obs/1", "value", "1.5") in public
    with pytest.raises(ValueError):
        of("Secret")


def test_neighbours_are_gated(spark):
    rows = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id long, ref long")
    t = {"t": spark.createDataFrame([(10, f"n{i}", "s") for i in range(8)], "k long, name string, secret string")}
    key = records.Key("ref", "t", "k", {"name": P("name", "Public"), "secret": P("secret", "Restricted")})
    near, skipped = records.neighbours(rows, "id", [key], t, "Internal")
    got = near.collect()
    assert len(got) == 5 and skipped == [] and {tuple(r.record) for r in got} == {("name",)} and {r.subject for r in got} == {"1"}
    assert {r.record["name"] for r in records.neighbours(rows, "id", [key], t, "Internal", hidden=("name",))[0].collect()} == {records.MASK}
    for k, allowed in ((key, {"other"}), (records.Key("ref", "t", "k", None), None), (records.Key("ref", "t", "k", {"secret": P("s", "Restricted")}), None)):
        none, why = records.neighbours(rows, "id", [k], t, "Internal", allowed)
        assert none.count() == 0 and len(why) == 1
    hits = spark.createDataFrame([("T/10", 1), ("T/7", 2), ("U/1", 3), ("odd", 4), (None, 5)], "iri string, n int")
    found = {r.n: (r.found, r.record) for r in records.enriched(hits, {"T": (t["t"], "k", {"k": P("k", "Public"), "secret": P("s", "Restricted")})}, "Public").collect()}
    assert found[1] == (True, '{"@id":"T/10","k":10}') and found[2] == (False, '{"@id":"T/7"}') and found[3][0] is found[4][0] is found[5][0] is False


def test_rules_from_a_folder(spark, tmp_path):
    (tmp_path / "b_far.sql").write_text("SELECT a.s, 'far' AS p, b.o FROM triples a JOIN triples b ON a.o = b.s WHERE a.p IN ('in', 'far') AND b.p = 'in' -- end\n;")
    (tmp_path / "a_top.sql").write_text("SELECT s, 'rdf:type' AS p, 'Top' AS o FROM triples WHERE p = 'far' AND o = 'd'")
    (tmp_path / "notes.txt").write_text("DROP TABLE x")
    t = spark.createDataFrame([("a", "in", "b"), ("b", "in", "c"), ("c", "in", "d"), ("d", "in", "a")], "s string, p string, o string")
    rules = rule_folder.rules_of(spark, str(tmp_path))
    assert list(rules) == ["a_top", "b_far"]
    got = {(r.s, r.p, r.o): (r.rule, r.round) for r in rule_folder.run_rules(t, rules).collect()}
    assert len([k for k in got if k[1] == "far"]) == 16 and got["a", "far", "c"] == ("b_far", 1) and got["a", "far", "a"] == ("b_far", 3)
    assert got["b", "rdf:type", "Top"] == ("a_top", 2) and {k[0] for k in got if k[2] == "Top"} == set("abcd")
    with pytest.raises(PermissionError):
        rule_folder.run_rules(t, {"bad": "SELECT reflect('java.lang.System', 'nanoTime') AS s, 'p' AS p, 'o' AS o"})


def test_lines_signatures_terms_impulses_keys(spark):
    lines = {
        "Jan  3 10:00:00 host app WARNING: disk 12 full": "host app disk NUM full", "1704067200123 error at 10.0.0.1 node": "at IPADDR node",
        "2024-01-02T03:04:05.6Z INFO job 00c0ffee99 took 1.5s ok": "job HEXVAL took NUM.5s ok", "s 1": None,
        "x 123e4567-e89b-12d3-a456-426614174000 trace: warning z": "x UUID z", None: None,
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    got = {r.t: r.c for r in df.select("t", T.plain_line(df.t, 6).alias("c")).collect()}
    assert got == lines
    sig = df.limit(1).selectExpr("array('IRI','num') as a", "array('iri','NUM') as b", "array('hex') as c")
    one = sig.select(*[T.template_signature(__import__("pyspark").sql.functions.lit("got <*> from <*>"), sig[k])[0].alias(k) for k in "abc"]).first()
    assert one.a == one.b != one.c and len(one.a) == 16
    term = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    s = {r.term: (r.frequency, r.score) for r in mining.entity_scores(term("node", "node", "abc"), term("node", "known", "known", "known", None), term("known")).collect()}
    assert set(s) == {"node"} and s["node"][0] == 5
    ev = spark.createDataFrame([("d", 0.0), ("d", 5.0), ("e", 100.0)], "k string, at double")
    i = {(r.k, r.bin): r.n for r in series.impulses(ev, "k", "at", 10.0, 10.0).collect()}
    assert i["d", 0] == 2 and i["d", 9] == pytest.approx(2 * 0.5**9) and i["e", 10] == 1 and ("d", 11) not in i
    far = series.impulses(ev, "k", "at", 1.0, 1.0, 0.0, 100.0)
    assert far.filter("k = 'd'").agg({"bin": "max"}).first()[0] == 5 + 13  # 0.5^13 is the last above 1e-4
    assert {(r.k, r.bin): r.n for r in series.impulses(ev, "k", "at", 10.0, 0.0).collect()} == {("d", 0): 2.0, ("e", 10): 1.0}
    t = {"a": spark.createDataFrame([(1,), (2,)], "a_key long"), "b": spark.createDataFrame([(1, 9), (2, 9), (None, 9)], "b_key long, x_key long"),
         "c": spark.createDataFrame([(1,), (3,)], "c_key long")}
    found = {(r.table_name, r.column_name, r.target) for r in tables.found_keys(t, {"a": "a_key"}).collect()}
    assert found == {("b", "b_key", "a")}
    assert [r["rank"] for r in tables.sample_rows(t["b"], ["b_key"], 2).collect()] == [1, 2] and tables.row_counts(t).filter("table_name = 'b'").first().n == 3


def test_retrieval_metrics_on_empty_and_wrong_hits(spark):
    hit = "qid long, vec_id long, cls string, rank int"
    plain = spark.createDataFrame([(1, 10, "a", 1), (1, 11, "b", 2), (1, 12, "b", 3), (2, 20, "c", 1)], hit)
    bounded = spark.createDataFrame([(1, 10, "a", 1), (1, 12, "b", 2)], hit)
    q = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c")], "qid long, expected string")
    times = spark.createDataFrame([("plain", i, float(v)) for i, v in enumerate([5, 1, 9])] + [("bounded", 1, 2.0)], "strategy string, qid long, ms double")
    got = {r.strategy: r for r in vectors.retrieval_metrics(plain, bounded, q, times).collect()}
    assert got["plain"].precision == pytest.approx((1 / 3 + 1) / 3, abs=1e-4) and got["plain"].mrr == pytest.approx(2 / 3, abs=1e-4)
    assert got["bounded"].wrong_class_blocked == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-4) and got["bounded"].queries == 3
    assert (got["plain"].p50_ms, got["plain"].p95_ms, got["bounded"].p95_ms) == (5.0, 9.0, 2.0)
    assert [r.tier for r in vectors.federated(spark.createDataFrame([("Public",), ("Restricted",), ("odd",)], "tier string"), "Restricted").collect()] == ["Public"]
