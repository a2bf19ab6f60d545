"""Rows as records of a graph: linked individuals with provenance, validity, quantities and roles; neighbours, subgraphs, whole records.

Columns above a ceiling are never read into a triple, a neighbour or a record;
a column without a tier is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import local_name

from .gates import MASK
from .vectors import TIERS, tier_rank

#: Columns that say when a record was made, from when and until when it holds, its unit and its number; first wins.
GENERATED = ("observed_at", "recorded_at", "generated_at", "asserted_at", "created_at")
VALID_FROM = ("valid_from", "effective_from", "start_date", "started_at")
VALID_UNTIL = ("valid_to", "valid_until", "effective_until", "end_date", "ended_at", "expiry_date", "credential_expiry")
UNIT, NUMBER = ("unit_of_measure", "uom", "unit"), ("numeric_value", "value", "measured_value", "amount", "quantity")
#: Parts of a column's name that make it a record's agent, and its role.
AGENT, ROLE = ("agent", "recorded_by", "initiated_by"), "role"


@dataclass
class Property:
    """How a column is read: predicate, tier, and the class that it links to (None for data)."""

    predicate: str
    tier: str
    target: str | None = None


def readable(mapping: dict[str, Property], ceiling: str) -> dict[str, Property]:
    if ceiling not in TIERS:
        raise ValueError(f"unknown tier {ceiling!r}")
    return {c: p for c, p in mapping.items() if p.tier in TIERS[: TIERS.index(ceiling) + 1]}


def individual(cls: str, key: Column) -> Column:
    """Class/key, the key without signs that an IRI can't hold."""
    return F.concat(F.lit(f"{cls}/"), F.coalesce(F.nullif(local_name(key.cast("string")), F.lit("")), F.lit("unknown")))


def individuals(
    df: DataFrame, cls: str, key: str, mapping: dict[str, Property], ceiling: str, events: tuple[str, ...] = (), agents: tuple[str, ...] = ("Agent",),
) -> DataFrame:
    """Triples (s, p, o, o_is_iri, tier) of all rows in one pass; a row gives several linked individuals.

    * the record: its type, data and links;
    * with a link to an agent: an activity between record and agent (provenance), with the time the record was made;
    * with times of validity: an extent of its own; nothing is made up where there are none;
    * with a unit and a number: a quantity;
    * with links to an event class and an agent and a role column: the record is a participation.

    Each triple has the greatest tier of the columns that it comes from.
    """
    ok = readable(mapping, ceiling)
    subject = individual(cls, F.col(key))
    node = lambda kind: individual(f"{cls}{kind}", F.col(key))
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    top = lambda *cols: max((ok[c].tier for c in cols if c), key=TIERS.index, default=TIERS[0])
    first = lambda names: next((c for n in names for c in ok if c.lower() == n), None)
    every = lambda names: [c for n in names for c in ok if c.lower() == n]
    cells: list[Column] = []

    def say(s: Column, p: str, o: Column, iri: bool, tier: str, when: Column | None = None) -> None:
        o = o.cast("string")
        cells.append(F.struct(s.alias("s"), F.lit(p).alias("p"), (o if when is None else F.when(when, o)).alias("o"), F.lit(iri).alias("o_is_iri"),
                              F.lit(tier).alias("tier")))

    say(subject, "rdf:type", F.lit(cls), True, TIERS[0])
    for c, p in ok.items():
        if p.target is None:
            say(subject, p.predicate, text(c), False, p.tier)
        else:
            say(subject, p.predicate, individual(p.target, F.col(c)), True, p.tier, text(c).isNotNull())
    links = {c: p for c, p in ok.items() if p.target}
    actor = next((c for c, p in links.items() if any(a in c.lower() for a in AGENT) or p.target in agents), None)
    made = every(GENERATED)
    at = F.coalesce(*map(text, made), F.lit(None).cast("string"))
    if actor:
        there, agent, act = text(actor).isNotNull(), individual(links[actor].target, F.col(actor)), node("Derivation")
        say(subject, "rdf:type", F.lit("prov:Entity"), True, top(actor), there)
        say(subject, "prov:wasGeneratedBy", act, True, top(actor), there)
        say(subject, "prov:wasAttributedTo", agent, True, top(actor), there)
        say(act, "rdf:type", F.lit("DerivationActivity"), True, top(actor), there)
        say(act, "prov:wasAssociatedWith", agent, True, top(actor), there)
        say(act, "prov:generated", subject, True, top(actor), there)
        if made:
            say(subject, "prov:generatedAtTime", at, False, top(actor, *made), there)
            say(act, "prov:startedAtTime", at, False, top(actor, *made), there)
    since, until = every(VALID_FROM), every(VALID_UNTIL)
    if since or until:
        lo, hi = (F.coalesce(*map(text, c), F.lit(None).cast("string")) for c in (since, until))
        some, tier = lo.isNotNull() | hi.isNotNull(), top(*since, *until)
        say(subject, "hasValidityPeriod", node("Validity"), True, tier, some)
        say(node("Validity"), "rdf:type", F.lit("TemporalExtent"), True, tier, some)
        say(node("Validity"), "validFrom", lo, False, top(*since))
        say(node("Validity"), "validUntil", hi, False, top(*until))
    units, numbers = every(UNIT), every(NUMBER)
    if units and numbers:
        unit = F.coalesce(*map(text, units))
        number = F.coalesce(*map(text, numbers)).try_cast("double")
        some, tier = unit.isNotNull() & number.isNotNull(), top(*units, *numbers)
        say(subject, "hasQuantity", node("Quantity"), True, tier, some)
        say(node("Quantity"), "rdf:type", F.lit("QuantityValue"), True, tier, some)
        say(node("Quantity"), "numericValue", number, False, top(*numbers), some)
        say(node("Quantity"), "unitOfMeasure", unit, False, top(*units), some)
    event = next((c for c, p in links.items() if p.target in events), None)
    person = next((c for c, p in links.items() if p.target in agents), None)
    role = next((c for c, p in ok.items() if ROLE in c.lower() and p.target is None), None)
    if event and person and role:
        some, tier = text(event).isNotNull() & text(person).isNotNull(), top(event, person)
        say(subject, "rdf:type", F.lit("Participation"), True, tier, some)
        say(subject, "participationIn", individual(links[event].target, F.col(event)), True, tier, some)
        say(subject, "participatingAgent", individual(links[person].target, F.col(person)), True, tier, some)
        say(subject, "participationRole", text(role), False, top(event, person, role), some)
    return df.filter(F.col(key).isNotNull()).select(F.explode(F.array(*cells)).alias("t")).select("t.*").filter("o is not null and o <> ''")


@dataclass
class Key:
    """A foreign key: column -> table.column, and the mapping of that table's columns."""

    column: str
    table: str
    to: str
    mapping: dict[str, Property] | None


def neighbours(
    rows: DataFrame, key: str, keys: list[Key], tables: dict[str, DataFrame], ceiling: str, allowed: set[str] | None = None,
    hidden: tuple[str, ...] = (), most: int = 5,
) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Rows that the foreign keys of rows point at: (subject, column, ref_table, ref_key, record), and keys not followed with the reason.

    A key is followed only to a table that is allowed and described, and only its columns within the ceiling are read; hidden
    columns are masked. At most ``most`` rows of a key value are taken, the first by their text.
    """
    out, skipped = None, []
    for k in keys:
        if allowed is not None and k.table not in allowed:
            skipped.append((k.column, k.table, "table isn't allowed"))
            continue
        cols = sorted(readable(k.mapping, ceiling)) if k.mapping else []
        if not cols:
            skipped.append((k.column, k.table, "no mapping" if not k.mapping else f"no column within {ceiling}"))
            continue
        value = lambda c: F.lit(MASK) if c in hidden else F.col(c).cast("string")
        record = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), value(c))]), lambda _, v: v.isNotNull())
        ref = tables[k.table].select(F.col(k.to).cast("string").alias("ref_key"), record.alias("record")).filter("ref_key is not null")
        order = W.partitionBy("ref_key").orderBy(F.to_json("record"))
        ref = ref.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")
        mine = rows.select(F.col(key).cast("string").alias("subject"), F.col(k.column).cast("string").alias("ref_key")).filter("ref_key is not null")
        found = mine.join(ref, "ref_key").select("subject", F.lit(k.column).alias("column"), F.lit(k.table).alias("ref_table"), "ref_key", "record")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "subject string, column string, ref_table string, ref_key string, record map<string,string>")
    return out, skipped


def result_subgraph(rows: DataFrame, key: str, cls: str, mapping: dict[str, Property], ceiling: str, near: DataFrame | None = None,
                    derived: DataFrame | None = None, near_tier: str = TIERS[0]) -> DataFrame:
    """One table of triples (s, p, o, o_is_iri, tier, via) of a result: its rows, key edges with their neighbours, derived facts.

    near as neighbours() gives it; derived(predicate, args, tier), whose first argument is a subject's key: one argument gives
    a type, two a link. A triple that several ways give stands once, with the greatest tier.
    """
    subject = lambda c: F.concat(F.lit(f"{cls}/"), F.col(c).cast("string"))
    cell = lambda p, o, iri, tier: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(iri).alias("o_is_iri"), F.lit(tier).alias("tier"))
    ok = readable(mapping, ceiling)
    cells = [cell("rdf:type", F.lit(cls), True, TIERS[0]), *[cell(p.predicate, F.col(c), False, p.tier) for c, p in sorted(ok.items())]]
    parts = [rows.select(subject(key).alias("s"), F.explode(F.array(*cells)).alias("t"), F.lit("row").alias("via")).select("s", "t.*", "via")]
    if near is not None:
        ref = F.concat_ws("/", "ref_table", "ref_key")
        edge = near.select(subject("subject").alias("s"), F.col("column").alias("p"), ref.alias("o"), F.lit(True).alias("o_is_iri"), F.lit(near_tier).alias("tier"),
                           F.lit("key").alias("via"))
        kind = near.select(ref.alias("s"), F.lit("rdf:type").alias("p"), F.col("ref_table").alias("o"), F.lit(True).alias("o_is_iri"),
                           F.lit(near_tier).alias("tier"), F.lit("key").alias("via"))
        data = near.select(ref.alias("s"), F.explode("record").alias("p", "o")).select(
            "s", "p", "o", F.lit(False).alias("o_is_iri"), F.lit(near_tier).alias("tier"), F.lit("neighbour").alias("via"))
        parts += [edge, kind, data]
    if derived is not None:
        one = F.size("args") == 1
        mine = derived.filter((F.size("args") >= 1) & (tier_rank(F.col("tier")) <= TIERS.index(ceiling))).select(
            F.concat(F.lit(f"{cls}/"), F.col("args")[0]).alias("s"), F.when(one, "rdf:type").otherwise(F.col("predicate")).alias("p"),
            F.when(one, F.col("predicate")).otherwise(F.get("args", F.lit(1))).alias("o"), one.alias("o_is_iri"), "tier", F.lit("derived").alias("via"))
        parts.append(mine.join(rows.select(subject(key).alias("s")).distinct(), "s", "left_semi"))
    every = reduce(DataFrame.unionByName, parts).filter("o is not null")
    rank = F.max(tier_rank(F.col("tier"))).alias("rank")
    g = every.groupBy("s", "p", "o", "o_is_iri").agg(rank, F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))
    return g.select("s", "p", "o", "o_is_iri", F.element_at(F.array(*map(F.lit, [*TIERS, "Unknown"])), F.col("rank") + 1).alias("tier"), "via")


def enriched(hits: DataFrame, tables: dict[str, tuple[DataFrame, str, dict[str, Property]]], ceiling: str, iri: str = "iri") -> DataFrame:
    """hits(iri, ..) with found and record: the whole row that an IRI class/key names, as JSON with its @id.

    tables: class -> (rows, key column, mapping). Hits are dealt to their table, each table is joined once, and only columns
    within the ceiling are read. An IRI of no table, or whose row is gone, has a record with its @id alone.
    """
    bare = lambda: F.to_json(F.struct(F.col(iri).alias("@id")))
    cls, key = F.substring_index(iri, "/", 1), F.regexp_extract(iri, "^[^/]*/(.*)$", 1)
    rest = hits.filter(~F.coalesce(cls.isin(*tables), F.lit(False))) if tables else hits
    out = rest.withColumn("found", F.lit(False)).withColumn("record", bare())
    for name, (df, key_col, mapping) in tables.items():
        ok = readable(mapping, ceiling)
        row = df.select(F.col(key_col).cast("string").alias("_key"), F.struct(*[F.col(c).alias(p.predicate) for c, p in sorted(ok.items())] or [F.lit(None).alias("none")]).alias("_row"))
        x = hits.filter(cls == name).withColumn("_key", key).join(row.dropDuplicates(["_key"]), "_key", "left")
        whole = F.to_json(F.struct(F.col(iri).alias("@id"), "_row.*"))
        x = x.withColumn("found", F.col("_row").isNotNull()).withColumn("record", F.when(F.col("_row").isNotNull(), whole).otherwise(bare()))
        out = out.unionByName(x.drop("_key", "_row"))
    return out
