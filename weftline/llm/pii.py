r"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

DataFrame functions only. For each kind a pattern proposes leftmost,
non-overlapping spans; candidates that a validator refuses are dropped and not
tried again. Kinds and validators: email (none needed), ip (four parts of 255
at most), card (13 to 19 digits, Luhn), phone (9 to 15 digits) and iban (ISO
7064 mod-97). The score of a span starts from its kind and rises or falls with
words in the 48 characters before and after it, up to the neighbouring spans.

Spans come from one split of a text at a pattern: lengths of the pieces and
matches give the offsets, so the cost is linear in the text. The patterns are
possessive and anchored where a run starts, which gives the same matches as
the plain ones without their quadratic search (``\G`` allows a match to follow
the last one directly). A text without the one character that a kind must
have isn't searched for it.

Edge cases: null and empty texts have no spans and the hash of the empty text;
offsets are in code points, ends exclusive; every row gives one row, repeated
ids too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern of each kind, and a cheap test that any text with a match passes.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
NEEDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9]",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

#: Score in hundredths before context, and the words that add to it or take from it.
PRIOR = {"email": 80, "ip": 55, "card": 75, "phone": 65, "iban": 85}
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
}
AGAINST = ("example", "test", "sample", "version", "id", "serial", "sha", "hash")
NEAR, STEP = 48, 15


def luhn(digits: Column) -> Column:
    """True where a string of digits has a valid Luhn sum."""
    at = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(at, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1))),
        F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """True where an IBAN, spaces removed, has remainder 1 (letters count 10 to 35)."""
    moved = F.concat(F.substring(text, 5, 99), F.substring(text, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda a, c: F.when(F.length(c) == 0, a).otherwise((a * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97),
    )
    return rest == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _has_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")


def spans_of(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, score) in order of start; text isn't null."""
    pattern = PATTERNS[kind]
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    # each match with the piece before and after it; zipped first, as a lambda would split the text for each match
    rows = F.transform(
        F.arrays_zip(found.alias("m"), pieces.alias("p"), F.slice(pieces, 2, F.size(pieces)).alias("q")),
        lambda r: F.struct(
            F.length(r["p"]).alias("gap"), F.coalesce(F.length(r["m"]), F.lit(0)).alias("n"),
            F.coalesce(r["m"].isNotNull() & _valid(kind, r["m"]), F.lit(False)).alias("ok"),
            F.lower(F.concat_ws(" ", F.substring(r["p"], -NEAR, NEAR), F.substring(r["q"], 1, NEAR))).alias("near"),
        ),
    )
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:int>>)")
    score = lambda near: (
        F.lit(PRIOR[kind]) + F.when(_has_word(near, CONTEXT[kind]), STEP).otherwise(0)
        - F.when(_has_word(near, AGAINST), STEP).otherwise(0)
    )
    scored = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + r["gap"] + r["n"]).alias("at"),
            F.when(r["ok"], F.concat(acc["out"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + r["gap"]).alias("start"),
                (acc["at"] + r["gap"] + r["n"]).alias("end"), score(r["near"]).alias("score"),
            )))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(NEEDS[kind]), scored).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end, score)) for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", *[spans_of(k, text).alias(k) for k in KINDS])
    return each.select("doc_id", F.concat(*KINDS).alias("spans"))


def redact(docs: DataFrame, min_score: int = 50, mask: str = "*") -> DataFrame:
    """docs with the spans of enough score replaced by as many mask characters (overlaps once)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(F.transform(
        F.filter(F.concat(*[spans_of(k, text) for k in KINDS]), lambda s: s["score"] >= min_score),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    ))
    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"],
                F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.repeat(F.lit(mask), s["end"] - F.greatest(s["start"], acc["at"])),
            ).alias("out"))),
    )
    return docs.withColumn("text", F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, hash of their spans, all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "iban"), line), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        count("iban").alias("n_iban"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def pii_sql() -> str:
    """The same in DuckDB SQL, from the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda j:
        CASE WHEN j % 2 = 1 THEN CAST(reverse({digits})[j] AS INT)
        ELSE [0,2,4,6,8,1,3,5,7,9][CAST(reverse({digits})[j] AS INT) + 1] END))"""
    moved = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4])"
    spelled = f"""list_reduce(list_transform(range(1, length({moved}) + 1), lambda j:
        CASE WHEN {moved}[j] BETWEEN '0' AND '9' THEN {moved}[j] ELSE CAST(ascii({moved}[j]) - 55 AS VARCHAR) END), lambda a, b: a || b)"""
    mod = f"""list_reduce(list_prepend(0, list_transform(string_split_regex({spelled}, ''), lambda c: TRY_CAST(c AS INT))),
        lambda a, b: (a * 10 + coalesce(b, 0)) % 97)"""
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{mod} = 1",
    }
    near = lambda words: "regexp_matches(near, '(?:^|[^a-z])(?:" + "|".join(words) + ")(?:[^a-z]|$)')"
    parts = []
    for k in KINDS:
        parts.append(f"""
{k}_a AS (SELECT rid, regexp_extract_all(t, '{plain[k]}') AS ms, string_split_regex(t, '{plain[k]}') AS ps FROM d),
{k}_b AS (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM {k}_a),
{k}_c AS (SELECT rid, ms[i] AS m, coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0)
    + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p))), 0) AS s,
    lower(concat_ws(' ', right(ps[i], {NEAR}), left(ps[i + 1], {NEAR}))) AS near FROM {k}_b),
{k} AS (SELECT rid, '{k}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e,
    {PRIOR[k]} + CASE WHEN {near(CONTEXT[k])} THEN {STEP} ELSE 0 END - CASE WHEN {near(AGAINST)} THEN {STEP} ELSE 0 END AS score
    FROM {k}_c WHERE {valid[k]})""")
    union = " UNION ALL ".join(f"SELECT *, {i} AS o FROM {k}" for i, k in enumerate(KINDS))
    agg = lambda what, cond: f"coalesce(string_agg({what}, ',' ORDER BY o, s) FILTER ({cond}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{",".join(parts)},
u AS ({union}),
g AS (SELECT rid, {counts}, {agg("concat_ws(':', kind, s, e)", "o < 4")} AS base,
    {agg("concat_ws(':', kind, s, e)", "true")} AS spans, {agg("CAST(score AS VARCHAR)", "true")} AS scores FROM u GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (rid)
"""
