"""Triples: materialisation, pattern joins, closures, rules, quality.

A triple table has s, p, o and o_is_iri. Fixpoints join the new facts of a
round only, drop known ones and write each round to the checkpoint folder, so
plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the cluster's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def to_triples(df: DataFrame, subject: Column, cls: str, columns: dict[str, str], links: dict[str, Column] | None = None) -> DataFrame:
    """A row for the type, for each non-empty column (predicate by column) and each link (an IRI)."""
    cell = lambda p, o, iri: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(iri).alias("i"))
    cells = [cell("rdf:type", F.lit(cls), True)]
    cells += [cell(p, F.col(c).cast("string"), False) for c, p in columns.items()]
    cells += [cell(p, c, True) for p, c in (links or {}).items()]
    x = df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("t"))
    return x.select("s", "t.p", "t.o", F.col("t.i").alias("o_is_iri")).filter("o is not null and trim(o) <> ''")


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Basic graph pattern: terms that start with ? are variables; one scan for each pattern, joined on what they share."""
    out = None
    for pattern in patterns:
        x, names = triples, {}
        for column, term in zip("spo", pattern, strict=True):
            if not term.startswith("?"):
                x = x.filter(F.col(column) == term)
            elif term[1:] in names:
                x = x.filter(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        x = x.select(*[F.col(c).alias(v) for v, c in names.items()])
        if out is None:
            out = x
            continue
        shared = sorted(set(out.columns) & set(x.columns))
        out = out.join(x, shared) if shared else out.crossJoin(x)
    return out.distinct()


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """OPTIONAL: left join on the shared variables."""
    return left.join(right, sorted(set(left.columns) & set(right.columns)), "left")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """FILTER NOT EXISTS: anti join on the shared variables."""
    return left.join(right, sorted(set(left.columns) & set(right.columns)), "left_anti")


def closure(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """All (a, b) that a path joins, with its shortest length; cycles end as known pairs are dropped."""
    step = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    known = new = cut(step.withColumn("depth", F.lit(1)))
    for depth in range(2, rounds + 1):
        hop = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = new.join(hop, "b").select("a", F.col("c").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def subclasses(edges: DataFrame, classes: list[str], sub: str = "sub", sup: str = "sup", rounds: int = 1000) -> DataFrame:
    """The classes and all below them, searched from the classes down: only what is reached is joined again."""
    below = edges.select(F.col(sup).alias("cls"), F.col(sub).alias("next")).distinct()
    known = new = cut(edges.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(classes)], "cls string"))
    for _ in range(rounds):
        new = cut(new.join(below, "cls").select(F.col("next").alias("cls")).distinct().join(known, "cls", "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


Atom = tuple[str, tuple[str, ...]]


def datalog(facts: dict[str, DataFrame], rules: list[tuple[str, Atom, list[Atom]]], rounds: int = 1000) -> DataFrame:
    """Least fixpoint of Horn rules (name, head, body), semi-naive: (predicate, args, rule, round); the first derivation stays.

    Facts are tables with columns a1, a2, ...; variables start with ?.
    """
    spark = next(iter(facts.values())).sparkSession
    arity = {p: len(df.columns) for p, df in facts.items()}
    packed = [
        df.select(F.lit(p).alias("predicate"), F.array(*[F.col(c).cast("string") for c in df.columns]).alias("args"),
                  F.lit(None).cast("string").alias("rule"), F.lit(0).alias("round"))
        for p, df in facts.items()
    ]
    known = new = cut(reduce(DataFrame.unionByName, packed).dropDuplicates(["predicate", "args"]))
    arity |= {head[0]: len(head[1]) for _, head, _ in rules}

    def view(source: DataFrame, atom: Atom) -> DataFrame:
        name, terms = atom
        x, cols = source.filter(F.col("predicate") == name), {}
        for i, t in enumerate(terms):
            at = F.col("args")[i]
            if not t.startswith("?"):
                x = x.filter(at == t)
            elif t in cols:
                x = x.filter(at == cols[t])
            else:
                cols[t] = at
        return x.select(*[c.alias(v[1:]) for v, c in cols.items()])

    for turn in range(1, rounds + 1):
        made = []
        for name, (head, terms), body in rules:
            for fresh in range(len(body)):
                x = None
                for i, atom in enumerate(body):
                    y = view(new if i == fresh else known, atom)
                    shared = sorted(set(x.columns) & set(y.columns)) if x is not None else []
                    x = y if x is None else x.join(y, shared) if shared else x.crossJoin(y)
                args = F.array(*[F.col(t[1:]) if t.startswith("?") else F.lit(t) for t in terms])
                made.append(x.select(F.lit(head).alias("predicate"), args.alias("args"), F.lit(name).alias("rule")))
        got = reduce(DataFrame.unionByName, made).groupBy("predicate", "args").agg(F.min("rule").alias("rule"))
        new = cut(got.join(known, ["predicate", "args"], "left_anti").withColumn("round", F.lit(turn)).select(*known.columns))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


SUB, SUBP, TYPE = "rdfs:subClassOf", "rdfs:subPropertyOf", "rdf:type"
#: The supported part of OWL RL, as rules over triple(s, p, o).
OWL_RULES: list[tuple[str, Atom, list[Atom]]] = [
    ("scm-sco", ("t", ("?a", SUB, "?c")), [("t", ("?a", SUB, "?b")), ("t", ("?b", SUB, "?c"))]),
    ("scm-spo", ("t", ("?a", SUBP, "?c")), [("t", ("?a", SUBP, "?b")), ("t", ("?b", SUBP, "?c"))]),
    ("cax-sco", ("t", ("?x", TYPE, "?c")), [("t", ("?x", TYPE, "?b")), ("t", ("?b", SUB, "?c"))]),
    ("prp-spo1", ("t", ("?x", "?q", "?y")), [("t", ("?x", "?p", "?y")), ("t", ("?p", SUBP, "?q"))]),
    ("prp-dom", ("t", ("?x", TYPE, "?c")), [("t", ("?p", "rdfs:domain", "?c")), ("t", ("?x", "?p", "?y"))]),
    ("prp-rng", ("t", ("?y", TYPE, "?c")), [("t", ("?p", "rdfs:range", "?c")), ("t", ("?x", "?p", "?y"))]),
    ("prp-inv1", ("t", ("?y", "?q", "?x")), [("t", ("?p", "owl:inverseOf", "?q")), ("t", ("?x", "?p", "?y"))]),
    ("prp-inv2", ("t", ("?y", "?p", "?x")), [("t", ("?p", "owl:inverseOf", "?q")), ("t", ("?x", "?q", "?y"))]),
    ("prp-symp", ("t", ("?y", "?p", "?x")), [("t", ("?p", TYPE, "owl:SymmetricProperty")), ("t", ("?x", "?p", "?y"))]),
    ("prp-trp", ("t", ("?x", "?p", "?z")),
     [("t", ("?p", TYPE, "owl:TransitiveProperty")), ("t", ("?x", "?p", "?y")), ("t", ("?y", "?p", "?z"))]),
    ("cax-eqc1", ("t", ("?x", TYPE, "?d")), [("t", ("?c", "owl:equivalentClass", "?d")), ("t", ("?x", TYPE, "?c"))]),
    ("cax-eqc2", ("t", ("?x", TYPE, "?c")), [("t", ("?c", "owl:equivalentClass", "?d")), ("t", ("?x", TYPE, "?d"))]),
]


def owl_closure(triples: DataFrame) -> DataFrame:
    """Derived triples with the rule that gave each: (s, p, o, rule, round)."""
    got = datalog({"t": triples.select(F.col("s").alias("a1"), F.col("p").alias("a2"), F.col("o").alias("a3"))}, OWL_RULES)
    return got.filter("round > 0").select(
        F.col("args")[0].alias("s"), F.col("args")[1].alias("p"), F.col("args")[2].alias("o"), "rule", "round"
    )


def construct(triples: DataFrame, where: list[tuple[str, str, str]], template: tuple[str, str, str]) -> DataFrame:
    """Triples of a template for each match, with the match's bindings as lineage."""
    x = match(triples, where)
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    bound = F.map_from_arrays(F.array(*[F.lit(c) for c in x.columns]), F.array(*[F.col(c) for c in x.columns]))
    return x.select(*[term(t).alias(n) for n, t in zip("spo", template, strict=True)], bound.alias("bindings"))


def explain(lineage: DataFrame, s: str, p: str, o: str) -> DataFrame:
    return lineage.filter((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o))


def inconsistencies(triples: DataFrame) -> DataFrame:
    """Individuals of two disjoint classes, and classes below owl:Nothing."""
    typed = triples.filter(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    apart = triples.filter(F.col("p") == "owl:disjointWith").select(F.col("s").alias("c"), F.col("o").alias("d"))
    both = typed.join(apart, "c").join(typed.withColumnRenamed("c", "d"), ["s", "d"])
    clash = both.select(F.lit("disjoint").alias("kind"), "s", F.concat_ws("|", "c", "d").alias("detail"))
    none = triples.filter((F.col("p") == SUB) & (F.col("o") == "owl:Nothing"))
    return clash.unionByName(none.select(F.lit("unsatisfiable").alias("kind"), "s", F.lit("owl:Nothing").alias("detail")))


def nodes_edges(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node (id, kind) and edge tables of a subgraph."""
    kind = F.when(~F.col("o_is_iri"), "literal").when(F.col("p") == TYPE, "type").otherwise("entity")
    nodes = triples.select(F.col("s").alias("id"), F.lit("entity").alias("kind")).unionByName(
        triples.select(F.col("o").alias("id"), kind.alias("kind"))
    ).groupBy("id").agg(F.min("kind").alias("kind"))
    return nodes, triples.filter("o_is_iri").select(F.col("s").alias("src"), F.col("p").alias("label"), F.col("o").alias("dst"))


#: Terms that need no type of their own, and what declares a licence.
BUILT_IN, LICENCE, LEAST_SIGNATURE = ("owl:Thing", "owl:Nothing"), ("dcterms:license", "dcterms:rights"), 3


def pitfalls(triples: DataFrame) -> DataFrame:
    """Modelling pitfalls with the element that has them: (pitfall, element).

    P04 classes that no property or hierarchy names, P07 classes that share a
    label, P08 no label, P11 no domain or no range, P13 object properties where
    nothing has an inverse, P19 several domains, P24 a class below itself, P30
    classes with the same three or more properties that aren't declared
    equivalent, P35 domains and ranges without a type, P41 an ontology without
    a licence.
    """
    p = lambda *names: triples.filter(F.col("p").isin(*names))
    kinds = lambda *c: p(TYPE).filter(F.col("o").isin(*c)).select("s").distinct()
    o = lambda df: df.select(F.col("o").alias("s"))
    without = lambda df, other: df.join(other.select("s").distinct(), "s", "left_anti")
    classes, objects = kinds("owl:Class"), kinds("owl:ObjectProperty")
    props = kinds("owl:ObjectProperty", "owl:DatatypeProperty")
    ends = p("rdfs:domain", "rdfs:range")
    labels = p("rdfs:label").join(classes, "s").select("s", F.lower(F.trim("o")).alias("label")).distinct()
    shared = labels.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    domains = p("rdfs:domain").join(props, "s").select(F.col("o").alias("c"), F.col("s").alias("prop")).distinct()
    signature = domains.groupBy("c").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("prop")).alias("sig"))
    signature = signature.filter(F.col("n") >= LEAST_SIGNATURE)
    twins = signature.groupBy("sig").agg(F.count("*").alias("k")).filter("k > 1").select("sig")
    used = o(ends).distinct().filter(~F.col("s").isin(*BUILT_IN) & ~F.col("s").rlike(r"^(xsd:|http://www\.w3\.org/2001/XMLSchema#)"))
    say = lambda code, df: df.select(F.lit(code).alias("pitfall"), F.col("s").alias("element"))
    parts = [
        say("P04", without(classes, o(ends.join(props, "s")).unionByName(p(SUB).select("s")).unionByName(o(p(SUB))))),
        say("P07", labels.join(shared, "label").select("s").distinct()),
        say("P08", without(classes.unionByName(props).distinct(), p("rdfs:label"))),
        say("P11", without(props, p("rdfs:domain")).unionByName(without(props, p("rdfs:range"))).distinct()),
        say("P13", objects.join(p("owl:inverseOf").select(F.lit(1).alias("one")).limit(1), how="left_anti")),
        say("P19", p("rdfs:domain").groupBy("s").agg(F.countDistinct("o").alias("n")).filter("n > 1")),
        say("P24", p(SUB).filter("s = o").select("s").distinct()),
        say("P30", without(signature.join(twins, "sig").select(F.col("c").alias("s")), p("owl:equivalentClass"))),
        say("P35", without(used, kinds("owl:Class", "rdfs:Datatype"))),
        say("P41", without(kinds("owl:Ontology"), p(*LICENCE))),
    ]
    return reduce(DataFrame.unionByName, parts)


def cycles(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that reach themselves."""
    return closure(edges, a, b).filter("a = b").select("a").distinct()
