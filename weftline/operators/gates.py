"""Plans, gates, policies, rules and scores over rows."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text_match import containing
from .vectors import TIERS, tier_rank

MASK = "•••"
LIMIT = 200
DERIVATIONS = ("MEASURED", "INFERRED", "IMPORTED", "SYNTHESIZED", "DEFAULT")


@dataclass
class Plan:
    """A validated question: one class, filters (property, operator, value), properties to show."""

    cls: str
    filters: list[tuple[str, str, object]] = field(default_factory=list)
    show: list[str] | None = None
    limit: int = LIMIT


@dataclass
class Mapping:
    """Class -> table, and property -> (column, tier)."""

    tables: dict[str, str]
    properties: dict[str, dict[str, tuple[str, str]]]

    def resolve(self, cls: str, prop: str) -> tuple[str, str]:
        """Exact name, else normalised (letters and digits, without has or is)."""
        norm = lambda s: re.sub(r"^(?:has|is)", "", re.sub(r"[^a-z0-9]", "", s.lower()))
        props = self.properties[cls]
        if prop in props:
            return props[prop]
        for k, v in props.items():
            if norm(k) == norm(prop):
                return v
        raise KeyError(f"{cls} has no property {prop}")


_OPS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "like": lambda c, v: c.like(v),
}


def validate(plan: Plan, mapping: Mapping) -> list[str]:
    """What is wrong with a plan."""
    if plan.cls not in mapping.tables:
        return [f"unknown class {plan.cls}"]
    wrong = [f"unknown operator {op}" for _, op, _ in plan.filters if op not in _OPS]
    for prop in [p for p, _, _ in plan.filters] + (plan.show or []):
        try:
            mapping.resolve(plan.cls, prop)
        except KeyError as e:
            wrong.append(str(e))
    return wrong


def compile_plan(plan: Plan, mapping: Mapping, tables: dict[str, DataFrame], ceiling: str) -> DataFrame:
    """Filters and mapped columns within the ceiling, as column expressions; refuses if nothing may be read."""
    if ceiling not in TIERS:
        raise ValueError(f"unknown tier {ceiling!r}")
    if wrong := validate(plan, mapping):
        raise ValueError("; ".join(wrong))
    rank = {t: i for i, t in enumerate(TIERS)}
    may = {c: p for p, (c, t) in mapping.properties[plan.cls].items() if rank.get(t, 99) <= rank[ceiling]}
    want = [mapping.resolve(plan.cls, p)[0] for p in plan.show] if plan.show else list(may)
    columns = sorted(c for c in want if c in may)
    if not columns:
        raise PermissionError(f"no column of {plan.cls} is within {ceiling}")
    df = tables[mapping.tables[plan.cls]]
    for prop, op, value in plan.filters:
        column, tier = mapping.resolve(plan.cls, prop)
        if rank.get(tier, 99) > rank[ceiling]:
            raise PermissionError(f"{prop} is above {ceiling}")
        df = df.filter(_OPS[op](F.col(column), F.lit(value)))
    return df.select(*columns).limit(plan.limit)


#: The nodes that a parsed or analysed query may consist of; anything else is refused, new kinds of command too.
QUERY_NODES = frozenset((
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit",
    "HiveTableRelation", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "LogicalRDD", "LogicalRelation",
    "DataSourceV2Relation", "Offset", "OneRowRelation", "Pivot", "Project", "Range", "RelationTimeTravel", "ResolvedHint", "Sample", "Sort",
    "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedPivot",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "View", "Window",
    "WithCTE", "WithWindowDefinition",
))
#: Functions that call any method of a class, by name and as resolved expressions.
REFLECTION = frozenset(("reflect", "java_method", "try_reflect", "CallMethodViaReflection", "TryReflect"))


def _walk(plan):
    """Nodes and expressions of a JVM plan, those of its subqueries and common tables too: (kind, object)."""
    todo = [("node", plan)]
    while todo:
        kind, x = todo.pop()
        yield kind, x
        each = lambda seq: [seq.apply(i) for i in range(seq.size())]
        name = x.getClass().getSimpleName()
        todo += [(kind, c) for c in each(x.children())]
        if kind == "node":
            todo += [("node", c) for c in each(x.innerChildren().toSeq()) if hasattr(c, "innerChildren") and "plans" in c.getClass().getName()]
            todo += [("expression", e) for e in each(x.expressions())]
        elif "plan" in dir(x) and ("Subquery" in name or name in ("Exists", "ListQuery", "InSubquery")):
            todo.append(("node", x.plan()))


def refused(plan) -> str | None:
    """Why a plan isn't a plain query: the first node that isn't allowed, or a call of a method by its name."""
    for kind, x in _walk(plan):
        name = x.getClass().getSimpleName()
        if kind == "node" and name not in QUERY_NODES:
            return name
        called = [name]
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = x.nameParts() if name == "UnresolvedFunction" else x.name()
            called.append(parts.last().lower())
        if REFLECTION.intersection(called):
            return called[-1]
    return None


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """A single query. What the parser makes of it must consist of allowed nodes throughout, before anything runs; views are then
    looked through as well."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if why := refused(plan):
        raise PermissionError(f"only queries are allowed, not {why}")
    df = spark.sql(sql)
    if why := refused(df._jdf.queryExecution().analyzed()):
        raise PermissionError(f"only queries are allowed, not {why}")
    return df


def limited(df: DataFrame, most: int = LIMIT) -> DataFrame:
    return df.limit(most)


def timed(df: DataFrame, seconds: float) -> list:
    """Rows, or TimeoutError when the jobs take longer; jobs with its tag are cancelled."""
    sc, tag = df.sparkSession.sparkContext, f"timed-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"query took more than {seconds} s") from None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def deidentify(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(MASK) for c in columns if c in df.columns})


def grounded(df: DataFrame, columns: list[str], question: str, most: int, order: str) -> DataFrame:
    """Rows that hold a word of the question (longer than two letters) in a column; the newest if it has none."""
    words = [w for w in re.findall(r"\w+", question.lower()) if len(w) > 2]
    if words:
        df = df.filter(reduce(Column.__or__, [F.lower(F.col(c).cast("string")).contains(w) for c in columns for w in words]))
    return df.orderBy(F.desc(order)).limit(most)


def input_gate(records: DataFrame, required: list[str], least: float, methods: tuple[str, ...] = DERIVATIONS) -> DataFrame:
    """Adds reasons (empty if accepted) and accepted."""
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing {c}") for c in required]
    checks.append(F.when(F.coalesce("confidence", F.lit(-1.0)) < least, "confidence below minimum"))
    checks.append(F.when(~F.coalesce(F.col("method").isin(*methods), F.lit(False)), "invalid derivation"))
    return records.withColumn("reasons", F.array_compact(F.array(*checks))).withColumn("accepted", F.size("reasons") == 0)


def reject_summary(gated: DataFrame) -> DataFrame:
    """Rejections by reason (first 60 letters) with the rate of all rows."""
    n = gated.agg(F.count("*").alias("rows"))
    x = gated.select(F.explode("reasons").alias("r")).groupBy(F.substring("r", 1, 60).alias("reason")).agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(n)).select("reason", "n", F.round(F.col("n") / F.col("rows"), 6).alias("rate"))


def policy(text: str) -> Column:
    """A predicate like: confidence >= 0.8 and status in (a, b). Types that don't fit make it false."""
    parts = []
    quoted = r"'[^']*'|\"[^\"]*\""
    clauses = [""]
    for piece in re.split(rf"({quoted})", text.strip()):  # an "and" inside of quotes is text
        first, *more = [piece] if re.fullmatch(quoted, piece) else re.split(r"\s+and\s+", piece, flags=re.I)
        clauses[-1] += first
        clauses += more
    for clause in clauses:
        m = re.fullmatch(r"(\w+)\s*(==|!=|>=|<=|>|<|not in|in|startswith|contains)\s*(.+)", clause.strip(), flags=re.I)
        if not m:
            raise ValueError(f"can't read {clause!r}")
        c, op, raw = F.col(m[1]), m[2].lower(), m[3].strip()
        plain = lambda s: s.strip().strip("'\"")
        if op in ("in", "not in"):
            some = c.cast("string").isin(*[plain(v) for v in re.findall(rf"{quoted}|[^,]+", raw.strip("()[]")) if v.strip()])
            x = some if op == "in" else ~some
        elif op in ("startswith", "contains"):
            x = getattr(c.cast("string"), op)(plain(raw))
        else:
            try:
                left, right = c.try_cast("double"), F.lit(float(plain(raw)))
            except ValueError:
                left, right = c.cast("string"), F.lit(plain(raw))
            x = _OPS[{"==": "="}.get(op, op)](left, right)
        parts.append(F.coalesce(x, F.lit(False)))
    return reduce(Column.__and__, parts)


def decide(rows: DataFrame, policies: list[tuple[str, str, str]], paused: bool = False) -> DataFrame:
    """The action of the first policy (name, predicate, action) that holds, skipping revoked ones; review if paused or none."""
    action, name = F.lit("review"), F.lit(None).cast("string")
    for n, text, act in reversed([p for p in policies if not p[1].startswith("REVOKED:")]):
        hit = policy(text)
        action, name = F.when(hit, act).otherwise(action), F.when(hit, n).otherwise(name)
    return rows.withColumn("policy", F.lit(None).cast("string") if paused else name).withColumn(
        "action", F.lit("review") if paused else action)


def boundary(rows: DataFrame, ceiling: str, classes: list[str], agent: str) -> DataFrame:
    """Reasons why a row may not cross to a partner; an empty class list admits none."""
    wrong_class = ~F.col("cls").isin(*classes) if classes else F.lit(True)
    return rows.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("tier") == "Restricted", "restricted"),
        F.when(tier_rank(F.col("tier")) > TIERS.index(ceiling), "tier above cap"),
        F.when(wrong_class, "class not allowed"),
        F.when(~F.col("agent").eqNullSafe(F.lit(agent)), "attribution mismatch"),
    )))


#: Weights and bands of a proposal's score, hazards of its kinds.
SCORE_WEIGHTS = {
    "evidence_volume": 0.25, "evidence_recency": 0.20, "cross_domain": 0.20, "consistency_risk": 0.20, "schema_alignment": 0.15,
}
BANDS, LOWEST_BAND = ((0.80, "REVIEW_NOW"), (0.50, "WEEKLY_BATCH")), "CANDIDATE"
KIND_RISK = {"NEW_CLASS": 0.80, "NEW_PROPERTY": 0.80, "NEW_CONSTRAINT": 0.60, "DEPRECATE": 0.40}
VOLUME, DAYS, DOMAINS, TITLE = 30, 30.0, 3, 40


def nearest_names(titles: DataFrame, known: DataFrame) -> DataFrame:
    """(title, _near): the greatest likeness of a title to a known name, of those that share a word or contain each other.

    0.7 where one contains the other, else the share of common words. Titles and names meet on their words
    and by scans for each other, not as all pairs; what shares nothing has likeness 0 and no row.
    """
    low = lambda c: F.lower(F.col(c))
    t = titles.filter("title <> ''").distinct().withColumn("_t", low("title"))
    n = known.filter("name <> ''").select(low("name").alias("_n")).distinct()
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    inside = containing(t, "_t", n.select("_n"), "_n").select("_t").unionByName(containing(n, "_n", t.select("_t"), "_t").select("_t"))
    left = t.select("_t", F.size(words("_t")).alias("a"), F.explode(words("_t")).alias("w")).distinct()
    right = n.select("_n", F.size(words("_n")).alias("b"), F.explode(words("_n")).alias("w"))
    both = left.join(right, "w").groupBy("_t", "_n", "a", "b").agg(F.count("*").alias("k"))
    apart = both.filter(~F.contains("_t", F.col("_n")) & ~F.contains("_n", F.col("_t")))
    every = inside.distinct().withColumn("v", F.lit(0.7)).unionByName(apart.select("_t", (F.col("k") / (F.col("a") + F.col("b") - F.col("k"))).alias("v")))
    return t.join(every.groupBy("_t").agg(F.max("v").alias("_near")), "_t").select("title", "_near")


def proposal_dimensions(proposals: DataFrame, evidence: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """proposals(proposal_id, title, kind, volume), evidence(text, source, generated_at), known(name): adds the five dimensions.

    A proposal's keyword is its title up to a dash. A seeded volume above 0 counts
    as it is; without a title volume is 0, recency 0.5, domains 0.33, alignment 0.5.
    """
    word = F.lower(F.substring(F.trim(F.split_part("title", F.lit("\u2014"), F.lit(1))), 1, TITLE))
    p = proposals.withColumn("_word", F.coalesce(word, F.lit("")))
    lowered = evidence.select(F.lower("text").alias("_text"), "source", "generated_at")
    seen = containing(lowered, "_text", p.select("_word"), "_word").groupBy("_word").agg(
        F.count("*").alias("_n"), F.max("generated_at").alias("_last"), F.countDistinct("source").alias("_sources"))
    near = nearest_names(p.select("title"), known)
    x = p.join(seen, "_word", "left").join(near, "title", "left")
    age = (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.to_timestamp("_last"))) / F.lit(86_400e6)
    no_word, clip = F.col("_word") == "", lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    risk = F.lit(0.5)
    for k, r in KIND_RISK.items():
        risk = F.when(F.col("kind") == k, r).otherwise(risk)
    return x.select(
        *proposals.columns,
        F.when(F.col("volume") > 0, F.least(F.col("volume").cast("double"), F.lit(1.0))).when(no_word, 0.0).otherwise(
            clip(F.coalesce("_n", F.lit(0)) / VOLUME)).alias("evidence_volume"),
        F.when(no_word, 0.5).when(F.col("_last").isNull(), 0.3).otherwise(clip(F.exp(-age / DAYS))).alias("evidence_recency"),
        F.when(F.coalesce("_sources", F.lit(0)) == 0, 0.33).otherwise(clip(F.col("_sources") / DOMAINS)).alias("cross_domain"),
        risk.alias("consistency_risk"),
        F.when(F.coalesce("title", F.lit("")) == "", 0.5).otherwise(
            F.greatest(1 - F.coalesce("_near", F.lit(0.0)), F.lit(0.3))).alias("schema_alignment"),
    )


def proposal_score(rows: DataFrame) -> DataFrame:
    """Weighted score of five dimensions and its band."""
    s = F.round(reduce(Column.__add__, [F.col(k) * w for k, w in SCORE_WEIGHTS.items()]), 3)
    band = F.lit(LOWEST_BAND)
    for least, name in reversed(BANDS):
        band = F.when(s >= least, name).otherwise(band)
    return rows.withColumn("score", s).withColumn("band", band)


#: What a metric's last runs must show for an alert: (layer, metric) -> (runs, severity, limit).
ALERTS = {
    ("L10", "ece"): (3, 2, 0.05), ("L8", "ari"): (2, 3, 0.70), ("L9", "ranker_auc"): (3, 3, 0.10),
    ("L11", "edge_jaccard"): (2, 3, 0.60), ("L12", "mean_merge_distance"): (3, 4, 0.15),
}


def drift_alerts(history: DataFrame) -> DataFrame:
    """history(layer, metric, run, value): alerts of the last runs of each metric: (layer, metric, severity, value, threshold, recent).

    Calibration error above its limit in every run, stability indices below
    theirs in the last, a ranking score that fell from its best, a distance that
    rose since the first. With fewer runs than a rule needs there is no alert.
    """
    last = W.partitionBy("layer", "metric").orderBy(F.desc("run"))
    some = history.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= max(n for n, _, _ in ALERTS.values()))
    got = some.groupBy("layer", "metric").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "value"))), lambda r: r["value"]).alias("h"))
    found = None
    for (layer, metric), (runs, severity, limit) in ALERTS.items():
        h = F.slice(F.col("h"), F.greatest(F.size("h") - runs + 1, F.lit(1)), F.lit(runs))
        x = got.filter((F.col("layer") == layer) & (F.col("metric") == metric) & (F.size("h") >= runs)).withColumn("recent", h)
        end = F.element_at("recent", -1)
        hit = {
            "ece": F.array_min("recent") > limit, "ari": end < limit, "edge_jaccard": end < limit,
            "ranker_auc": F.array_max("recent") - end > limit, "mean_merge_distance": end - F.col("recent")[0] > limit,
        }[metric]
        x = x.filter(hit).select("layer", "metric", F.lit(severity).alias("severity"), end.alias("value"), F.lit(limit).alias("threshold"), "recent")
        found = x if found is None else found.unionByName(x)
    return found


def slot_condition(column: Column, op: str, value=None) -> Column:
    """A rule's condition on a slot: = != < <= > >= regex in exists not_null; a null slot meets none but !=."""
    if op in ("exists", "not_null"):
        return column.isNotNull()
    if op == "regex":
        hit = column.cast("string").rlike(value)
    elif op == "in":
        if not isinstance(value, (list, tuple)):
            raise ValueError("in takes a list")
        hit = column.isin(*value)
    elif op in _OPS and op != "like":
        hit = _OPS[op](column, F.lit(value))
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(hit, F.lit(op == "!="))


def slot_rule(rows: DataFrame, conditions: list[tuple], assertion: tuple[str, str], subject: str) -> DataFrame:
    """Triples that a rule asserts of the rows that meet all its conditions (column, operator, value): (s, p, o)."""
    hit = reduce(Column.__and__, [slot_condition(F.col(c), *rest) for c, *rest in conditions], F.lit(True))
    return rows.filter(hit).select(F.col(subject).alias("s"), F.lit(assertion[0]).alias("p"), F.lit(str(assertion[1])).alias("o"))


def psi(old: Column, new: Column, floor: float = 1e-4) -> Column:
    """One bin's part of the population stability index."""
    a, b = F.greatest(old, F.lit(floor)), F.greatest(new, F.lit(floor))
    return (b - a) * F.log(b / a)


def drift_level(index: Column) -> Column:
    return F.when(index > 0.25, "CRITICAL").when(index > 0.1, "WARNING").otherwise("OK")
