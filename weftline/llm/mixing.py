"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

Leaves are (domain, lang, source). A token budget is passed down the tree:
children of a node share its tokens by weight, and none gets more than it can
supply (its tokens times ``max_epochs``). What a child can't use goes to its
siblings by weight; only when a whole node is short does its parent pass the
rest to that node's siblings. A leaf reads whole epochs of its documents and
then a prefix of one more; each epoch has an order of its own, from a seeded
hash, and a document belongs to the prefix when the tokens before it are below
the leaf's remaining budget.

All amounts are integers, so the plan is the same in any engine. The running
sum has two steps, a bucket of the hash and the rows of a bucket, so a leaf
that holds a third of all rows is still 1/4096 of that in any one window. The
hash takes id and text, so rows without an id spread too. Only sources (a
catalogue, with one row each) meet in a window by language.

Edge cases: null lang, source or text count as the empty text; a text without
words has no tokens and comes with its leaf's prefix like any other; a leaf below
a weight of 0 gets nothing and supplies nothing, so its tokens are no room of its
node; rows that repeat an id take one place each, in an order that only equal
rows can swap; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, free_name

#: Target weights by level; what isn't listed has the weight under "*".
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "code": 2, "*": 1},
    "lang": {"en": 6, "fr": 2, "de": 2, "es": 2, "*": 1},
    "source": {"src0": 2, "*": 1},
}
#: A source's domain is that of its number's remainder.
DOMAINS = ("web", "books", "code")
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number % len(DOMAINS)).cast("int") + 1)


def _weight(level: str, column: str, weights: dict) -> Column:
    named = weights[level]
    out = F.lit(named["*"])
    for k, w in named.items():
        if k != "*":
            out = F.when(F.col(column) == k, w).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], key: str, amount: str) -> DataFrame:
    """Adds ``got``: the amount of a parent over its children by weight w, none above its capacity cap."""
    # children with the smallest capacity for their weight fill up first; compared as cap * W / w
    order = [F.when(F.col("w") > 0, F.col("cap").cast("decimal(38,12)") / F.col("w")).asc_nulls_last(), F.col(key)]
    by = W.partitionBy(*parent).orderBy(*order)
    before = F.sum("cap").over(by) - F.col("cap")
    rest_w = F.sum("w").over(W.partitionBy(*parent)) - (F.sum("w").over(by) - F.col("w"))
    x = nodes.withColumn("_rest", F.col(amount) - before).withColumn("_w", rest_w)
    x = x.withColumn("_full", (F.col("w") > 0) & (F.col("cap") * F.col("_w") <= F.col("_rest") * F.col("w")))
    # the first child that isn't full fixes what a unit of weight gets
    whole = W.partitionBy(*parent)
    first = F.min_by(F.struct("_rest", "_w"), F.when(~F.col("_full") & (F.col("w") > 0), F.struct(*[
        F.when(F.col("w") > 0, F.col("cap").cast("decimal(38,12)") / F.col("w")).alias("o"), F.col(key).alias("k")
    ]))).over(whole)
    x = x.withColumn("_f", first)
    part = F.expr("(w * _f._rest) div nullif(_f._w, 0)")
    got = F.when(F.col("_full"), F.col("cap")).when(F.col("w") > 0, F.coalesce(part, F.lit(0))).otherwise(F.lit(0))
    return x.withColumn("got", F.least(got.cast("long"), F.col("cap"))).drop("_rest", "_w", "_full", "_f")


def plan_budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: dict = WEIGHTS) -> DataFrame:
    """leaves: (domain, lang, source, supply). Adds budget, the leaf's tokens."""
    used = F.lit(True)
    for level in ("domain", "lang", "source"):
        used = used & (_weight(level, level, weights) > 0)
    cap = leaves.withColumn("cap", F.when(used, F.col("supply") * max_epochs).otherwise(0).cast("long"))
    langs = cap.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    total = domains.agg(F.sum("cap").alias("tcap"), F.sum("supply").alias("supply"))
    total = total.select(F.least(budget.cast("long"), F.col("tcap")).alias("amount"))
    d = domains.withColumn("w", _weight("domain", "domain", weights)).crossJoin(total).withColumn("root", F.lit(0))
    d = _share(d, ["root"], "domain", "amount").select("domain", F.col("got").alias("amount"))
    g = langs.withColumn("w", _weight("lang", "lang", weights)).join(d, "domain")
    g = _share(g, ["domain"], "lang", "amount").select("domain", "lang", F.col("got").alias("amount"))
    s = cap.withColumn("w", _weight("source", "source", weights)).join(g, ["domain", "lang"])
    return _share(s, ["domain", "lang"], "source", "amount").select(
        "domain", "lang", "source", "supply", F.col("got").alias("budget")
    )


def _leaf(lang: Column, source: Column) -> list[Column]:
    lang, source = (F.coalesce(c, F.lit("")) for c in (lang, source))
    return [domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source")]


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _place(seed: str, whole: Column, digest: Column) -> Column:
    """A row's place in the order of the epoch that is read in part, which has its number in the hash."""
    return F.md5(F.concat_ws(":", F.lit(seed), whole, F.col("doc_id"), digest))


def _placed(
    docs: DataFrame, scratch: Scratch, fraction: tuple[int, int], max_epochs: int, weights: dict, seed: str,
    carry: tuple[str, ...], order: tuple[str, ...] = ("h", "doc_id", "tokens"),
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, domain, lang, source, tokens, leaf_budget, copies, whole, h, carried columns) for each row, and the plan by leaf."""
    rows = docs.select(
        "doc_id", *_leaf(F.col("lang"), F.col("source")),
        word_count(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"), _digest(F.col("text")).alias("digest"), *carry,
    )
    rows = scratch.save(rows, "tokens")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("tokens").alias("supply"))
    budget = F.expr(f"(supply * {fraction[0]}) div {fraction[1]}")
    plan = plan_budgets(leaves, budget, max_epochs, weights).select(
        *leaf, F.col("budget").alias("leaf_budget"),
        F.expr("coalesce(budget div nullif(supply, 0), 0)").alias("whole"),
        F.expr("coalesce(budget % nullif(supply, 0), 0)").alias("rest"),
    )
    # written, so that its size is known where the join is planned: a small plan is broadcast, a large one isn't
    plan = scratch.save(plan, "plan")
    keyed = rows.join(plan, leaf).withColumn("h", _place(seed, F.col("whole"), F.col("digest"))).withColumn(
        "b", F.substring("h", 1, BUCKET_DIGITS))
    buckets = keyed.groupBy(*leaf, "b").agg(F.sum("tokens").alias("n"))
    run = W.partitionBy(*leaf).orderBy("b")
    buckets = buckets.select(*leaf, "b", (F.sum("n").over(run) - F.col("n")).alias("base"))
    inside = F.sum("tokens").over(
        W.partitionBy(*leaf, "b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    placed = keyed.withColumn("_in", inside - F.col("tokens")).join(buckets, [*leaf, "b"])
    copies = F.col("whole") + (F.col("base") + F.col("_in") < F.col("rest")).cast("long")
    return placed.select("doc_id", *leaf, "tokens", "leaf_budget", copies.alias("copies"), "whole", "h", *carry), plan


def mix(
    docs: DataFrame, scratch: Scratch, fraction: tuple[int, int] = (3, 5), max_epochs: int = 2,
    weights: dict = WEIGHTS, seed: str = "mix", carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each row is read: (doc_id, domain, lang, source, tokens, leaf_budget, copies), a row for each row.

    The budget is fraction (as a quotient of integers) of all tokens. copies
    counts the epochs that hold the row, 0 if none does. Carried columns come last.
    """
    return _placed(docs, scratch, fraction, max_epochs, weights, seed, carry)[0].drop("whole", "h")


def selected(
    docs: DataFrame, key: str, scratch: Scratch, fraction: tuple[int, int] = (3, 5), max_epochs: int = 2,
    weights: dict = WEIGHTS, seed: str = "mix",
) -> DataFrame:
    """The rows of docs that ``mix`` reads at least once, with all their columns; key tells rows apart.

    What is read of a leaf is a prefix of its order, so the last row of that
    prefix decides about every other: texts meet a table with one row for each
    leaf, which is broadcast while it is small, and aren't shuffled by row.
    """
    placed, plan = _placed(docs, scratch, fraction, max_epochs, weights, seed, (key,), ("h", key))
    leaf, last = free_name(docs, "leaf"), free_name(docs, "last")
    lasts = placed.filter("copies > 0").groupBy(F.struct("domain", "lang", "source").alias(leaf)).agg(
        F.max(F.struct("whole", "h", F.col(key).alias("key"))).alias(last))
    lasts = scratch.save(lasts, "lasts", plan.count())
    rows = docs.withColumn(leaf, F.struct(*_leaf(F.col("lang"), F.col("source")))).join(lasts, leaf)
    place = F.struct(_place(seed, F.col(last)["whole"], _digest(F.col("text"))).alias("h"), F.col(key).alias("key"))
    return rows.filter(place <= F.struct(F.col(last)["h"], F.col(last)["key"])).drop(leaf, last)


def mix_sql(fraction: tuple[int, int] = (3, 5), max_epochs: int = 2, weights: dict = WEIGHTS, seed: str = "mix") -> str:
    """The same in DuckDB SQL."""

    def case(level: str) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights[level].items() if k != "*")
        return f"CAST(CASE {level} {whens} ELSE {weights[level]['*']} END AS HUGEINT)"

    def share(name: str, nodes: str, parent: str, key: str) -> str:
        o = f"CASE WHEN w > 0 THEN cap::DOUBLE / w END ASC NULLS LAST, {key}"
        return f"""
{name}_a AS (SELECT *, amount - (sum(cap) OVER (PARTITION BY {parent} ORDER BY {o}) - cap) AS rest,
   sum(w) OVER (PARTITION BY {parent}) - (sum(w) OVER (PARTITION BY {parent} ORDER BY {o}) - w) AS rw,
   row_number() OVER (PARTITION BY {parent} ORDER BY {o}) AS k FROM {nodes}),
{name}_b AS (SELECT *, w > 0 AND cap * rw <= rest * w AS isfull FROM {name}_a),
{name}_f AS (SELECT {parent}, arg_min(rest, k) AS fr, arg_min(rw, k) AS fw FROM {name}_b WHERE NOT isfull AND w > 0 GROUP BY {parent}),
{name} AS (SELECT x.*, least(cap, CASE WHEN isfull THEN cap WHEN w > 0 AND fw > 0 THEN (w * fr) // fw ELSE 0 END) AS got
   FROM {name}_b x LEFT JOIN {name}_f USING ({parent}))"""

    names = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""
WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens, md5(coalesce(text, '')) AS digest FROM documents),
rows_ AS (SELECT *, ([{names}])[coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1] AS domain FROM r),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS supply,
   CASE WHEN {case("domain")} > 0 AND {case("lang")} > 0 AND {case("source")} > 0 THEN sum(tokens)::HUGEINT * {max_epochs} ELSE 0 END AS cap FROM rows_ GROUP BY domain, lang, source),
langs AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY ALL),
doms AS (SELECT domain, sum(cap)::HUGEINT AS cap FROM langs GROUP BY ALL),
tot AS (SELECT least((sum(supply)::HUGEINT * {fraction[0]}) // {fraction[1]}, sum(cap)::HUGEINT) AS amount FROM leaves),
d0 AS (SELECT 0 AS root, doms.*, amount, {case("domain")} AS w FROM doms, tot),
{share("d1", "d0", "root", "domain")},
g0 AS (SELECT langs.*, d1.got AS amount, {case("lang")} AS w FROM langs JOIN d1 USING (domain)),
{share("g1", "g0", "domain", "lang")},
s0 AS (SELECT leaves.*, g1.got AS amount, {case("source")} AS w FROM leaves JOIN g1 USING (domain, lang)),
{share("s1", "s0", "domain, lang", "source")},
keyed AS (SELECT rows_.*, s1.got AS leaf_budget, coalesce(s1.got // nullif(s1.supply, 0), 0) AS whole,
   coalesce(s1.got % nullif(s1.supply, 0), 0) AS rest FROM rows_ JOIN s1 USING (domain, lang, source)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
   ORDER BY md5(concat_ws(':', '{seed}', whole, doc_id, digest)), doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS before FROM keyed)
SELECT doc_id, domain, lang, source, tokens, leaf_budget::BIGINT AS leaf_budget,
   (whole + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed
"""
