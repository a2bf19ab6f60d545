"""Derivations with their premises, the sensitivity that follows from them, shape and profile of an ontology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import SUB, TYPE, Atom, cut
from .vectors import TIERS, tier_rank

FACT = ["predicate", "args"]


def derivations(facts: DataFrame, rules: list[tuple[str, Atom, list[Atom]]]) -> DataFrame:
    """Every way in which a rule gives a fact from known ones: (predicate, args, rule, premises).

    facts(predicate, args) are those of a closed set, as datalog() leaves it. A fact that several rules or several
    bindings give has a row for each, with its premises as an array of (predicate, args).
    """
    out = []
    known = facts.select(*FACT).distinct()
    for name, (head, terms), body in rules:
        x = None
        for i, (predicate, wanted) in enumerate(body):
            y, seen = known.filter(F.col("predicate") == predicate), {}
            for j, t in enumerate(wanted):
                at = F.col("args")[j]
                if not t.startswith("?"):
                    y = y.filter(at == t)
                elif t in seen:
                    y = y.filter(at == seen[t])
                else:
                    seen[t] = at
            y = y.select(*[c.alias(v[1:]) for v, c in seen.items()], F.struct(*FACT).alias(f"_p{i}"))
            shared = sorted(set(x.columns) & set(y.columns)) if x is not None else []
            x = y if x is None else x.join(y, shared) if shared else x.crossJoin(y)
        args = F.array(*[F.col(t[1:]) if t.startswith("?") else F.lit(t) for t in terms])
        premises = F.array(*[F.col(f"_p{i}") for i in range(len(body))])
        out.append(x.select(F.lit(head).alias("predicate"), args.alias("args"), F.lit(name).alias("rule"), premises.alias("premises")))
    return reduce(DataFrame.unionByName, out)


def sensitivity(asserted: DataFrame, derived: DataFrame, rounds: int = 1000) -> DataFrame:
    """(predicate, args, tier): the greatest tier of all premises through all derivations, for every fact.

    asserted(predicate, args, tier), derived as derivations() gives it. A fixpoint over the ordered tiers: only facts
    whose tier rose in a round are looked at as premises in the next one, and a tier can rise a few times only,
    so it ends however derivations go in circles. Unknown tiers count above all.
    """
    links = cut(derived.select(*FACT, F.explode("premises").alias("p")).select(
        *FACT, F.col("p.predicate").alias("from_predicate"), F.col("p.args").alias("from_args")).distinct())
    known = asserted.groupBy(*FACT).agg(F.max(tier_rank(F.col("tier"))).alias("rank"))
    known = cut(known.unionByName(derived.select(*FACT).distinct().withColumn("rank", F.lit(0))).groupBy(*FACT).agg(F.max("rank").alias("rank")))
    risen = known.filter("rank > 0")
    for _ in range(rounds):
        up = risen.withColumnsRenamed({"predicate": "from_predicate", "args": "from_args"})
        pushed = links.join(up, ["from_predicate", "from_args"]).groupBy(*FACT).agg(F.max("rank").alias("pushed"))
        risen = cut(known.join(pushed, FACT).filter("pushed > rank").select(*FACT, F.col("pushed").alias("rank")))
        if risen.isEmpty():
            break
        known = cut(known.unionByName(risen).groupBy(*FACT).agg(F.max("rank").alias("rank")))
    names = F.array(*map(F.lit, [*TIERS, "Unknown"]))
    return known.select(*FACT, F.element_at(names, F.col("rank") + 1).alias("tier"))


def weaker_children(closed: DataFrame, tiers: DataFrame) -> DataFrame:
    """Inferred subclass edges whose child has a weaker tier than its parent: (child, parent, child_tier, parent_tier).

    closed(s, p, o) are inferred triples, tiers(cls, tier) those of the classes; classes without a tier aren't judged.
    """
    edges = closed.filter((F.col("p") == SUB) & (F.col("s") != F.col("o"))).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    side = lambda k: tiers.select(F.col("cls").alias(k), F.col("tier").alias(f"{k}_tier"))
    x = edges.join(side("child"), "child").join(side("parent"), "parent")
    return x.filter(tier_rank(F.col("child_tier")) < tier_rank(F.col("parent_tier")))


def depths(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """edges(child, parent) -> (node, depth): nodes on the longest path down from a root; null for those in or below a cycle.

    In each round the nodes without a parent among those that are left are taken off; their depth is the
    round's number. The work is the edges once a round they are left in, and the rounds are the longest path.
    """
    left = cut(edges.filter("child <> parent and child is not null and parent is not null").select("child", "parent").distinct())
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).filter("node is not null").distinct()
    out, rest = None, cut(nodes)
    for depth in range(1, rounds + 1):
        off = cut(rest.join(left.select(F.col("child").alias("node")).distinct(), "node", "left_anti"))
        if off.isEmpty():
            break
        level = off.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
        rest = cut(rest.join(off, "node", "left_anti"))
        left = cut(left.join(off.withColumnRenamed("node", "parent"), "parent", "left_anti"))
    looped = rest.withColumn("depth", F.lit(None).cast("int"))
    return looped if out is None else out.unionByName(looped)


def shape(triples: DataFrame) -> DataFrame:
    """One row: classes, properties, roots, leaves, depth of the hierarchy and its ratios of richness.

    inheritance_richness is subclass edges a class, attribute_richness data properties a class, relationship_richness the
    share of object properties among those and subclass edges; below about 1 the first means a flat list. cyclic
    counts nodes in or below a cycle, which have no depth.
    """
    typed = lambda *c: triples.filter((F.col("p") == TYPE) & F.col("o").isin(*c)).select("s").distinct()
    classes, objects, data = typed("owl:Class"), typed("owl:ObjectProperty"), typed("owl:DatatypeProperty")
    edges = cut(triples.filter((F.col("p") == SUB) & (F.col("s") != F.col("o"))).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct())
    count = lambda df, name: df.agg(F.count("*").alias(name))
    d = cut(depths(edges))
    lone = classes.join(d.select(F.col("node").alias("s")), "s", "left_anti")
    without = lambda side: classes.join(edges.select(F.col(side).alias("s")).distinct(), "s", "left_anti")
    parts = [
        count(classes, "classes"), count(objects.unionByName(data).distinct(), "properties"), count(data, "data_properties"), count(objects, "object_properties"),
        count(without("child"), "roots"), count(without("parent"), "leaves"), count(edges, "subclass_edges"),
        d.agg(F.max("depth").alias("deepest"), F.count_if(F.col("depth").isNull()).alias("cyclic")), count(lone, "lone"),
        count(typed("owl:Restriction"), "restrictions"), count(triples.filter(F.col("p") == "owl:equivalentClass").select("s").distinct(), "defined_classes"),
    ]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # rows of counts, one each
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 2)
    links = F.col("object_properties") + F.col("subclass_edges")
    return one.withColumns({
        "max_depth": F.coalesce("deepest", F.when(F.col("lone") > 0, 1).otherwise(0)),
        "inheritance_richness": ratio(F.col("subclass_edges"), F.col("classes")), "attribute_richness": ratio(F.col("data_properties"), F.col("classes")),
        "relationship_richness": ratio(F.col("object_properties"), links),
    }).drop("deepest", "lone", "subclass_edges")


#: Constructs that OWL 2 EL doesn't have: name -> (predicate, object or None for any).
BEYOND_EL = {
    "role chains": ("owl:propertyChainAxiom", None), "nominals": ("owl:oneOf", None), "owl:inverseOf": ("owl:inverseOf", None),
    "owl:SymmetricProperty": (TYPE, "owl:SymmetricProperty"), "owl:InverseFunctionalProperty": (TYPE, "owl:InverseFunctionalProperty"),
    "class disjointness": ("owl:disjointWith", None), "all disjoint classes": (TYPE, "owl:AllDisjointClasses"),
    "owl:unionOf (disjunction)": ("owl:unionOf", None), "owl:complementOf (negation)": ("owl:complementOf", None),
}


def owl_profile(triples: DataFrame) -> DataFrame:
    """One row: the smallest OWL 2 profile of an ontology, the constructs that ask for it with their triples, a reasoner that fits."""
    kind = F.lit(None).cast("string")
    for name, (p, o) in BEYOND_EL.items():
        hit = (F.col("p") == p) if o is None else (F.col("p") == p) & (F.col("o") == o)
        kind = F.when(hit, name).otherwise(kind)
    n = triples.groupBy(kind.alias("construct")).agg(F.count("*").alias("n"))
    found = F.array_sort(F.collect_list(F.when(F.col("construct").isNotNull(), F.struct("construct", "n"))))
    got = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("axioms"), found.alias("constructs"))
    dl = F.size("constructs") > 0
    return got.select(
        F.when(dl, "OWL 2 DL").otherwise("OWL 2 EL").alias("profile"), "axioms",
        F.array_join(F.transform("constructs", lambda c: F.concat_ws(":", c["construct"], c["n"].cast("string"))), ", ").alias("constructs"),
        F.when(dl, "HermiT").otherwise("ELK").alias("reasoner"))
