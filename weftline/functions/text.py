"""Scalar functions on text: masks, names, tokens, identifiers, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks of variable parts, in the order they are applied.
MASKS = (
    (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?", "<TS>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\d+(?:\.\d+)?", "<NUM>"),
)


def mask(text: Column) -> Column:
    """Variable parts of a line become their kind."""
    for pattern, name in MASKS:
        text = F.regexp_replace(text, pattern, name)
    return text


def clean_line(text: Column, least: int = 10) -> Column:
    """A line without leading time and level, masked; null if little is left."""
    t = F.regexp_replace(text, r"^\s*\[?\d{4}-\d\d-\d\d[T ][\d:.,]+Z?\]?\s*", "")
    t = F.regexp_replace(t, r"^\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\]?:?\s+", "")
    t = F.trim(mask(t))
    return F.when(F.length(t) > least, t)


#: Leading times (ISO 8601, BSD syslog, epoch), levels anywhere, and what variable parts become.
LINE_TIMES = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\s*", r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+", r"^\d{10,13}\s+",
)
LINE_LEVELS = r"(?i)\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)\b\s*:?\s*"
LINE_PARTS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "UUID"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "IPADDR"),
    (r"\b[0-9a-fA-F]{8,}\b", "HEXVAL"), (r"\b\d+(?:\.\d+)?\b", "NUM"),
)


def plain_line(text: Column, least: int = 10) -> Column:
    """A line without leading times and without levels wherever they stand, its variable parts named; null if little is left."""
    t = F.trim(text)
    for pattern in (*LINE_TIMES, LINE_LEVELS):
        t = F.regexp_replace(t, pattern, "")
    for pattern, name in LINE_PARTS:
        t = F.regexp_replace(t, pattern, name)
    t = F.trim(t)
    return F.when(F.length(t) > least, t)


def template_signature(template: Column, slot_types: Column) -> tuple[Column, Column, Column]:
    """(signature, tokens hash, slots hash) of a template's sorted words and its slots' types, 16 hexadecimal digits each."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    bare = F.lower(F.regexp_replace(F.coalesce(template, F.lit("")), r"<\*>", " "))
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit("[a-z_]{2,}"), 0)))
    a = short(F.concat(F.lit("tokens:"), F.array_join(tokens, ",")))
    b = short(F.concat(F.lit("slots:"), F.array_join(F.transform(F.coalesce(slot_types, F.array().cast("array<string>")), F.upper), ",")))
    return short(F.concat_ws("|", a, b)), a, b


def words(text: Column, pattern: str = r"[A-Za-z0-9_]{2,}") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def camel_case(name: Column) -> Column:
    """snake_case as CamelCase."""
    return F.regexp_replace(F.initcap(F.regexp_replace(name, "[_-]+", " ")), " ", "")


def label(name: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(name, "[_-]+", " ")))


def normal_name(name: Column) -> Column:
    """Letters and digits in lower case, without a leading has or is."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "^(?:has|is)", "")


def local_name(value: Column) -> Column:
    """A value as the last part of an IRI; all-capital parts are lowered first."""
    parts = F.filter(F.split(F.trim(value), r"[^A-Za-z0-9]+"), lambda p: p != "")
    cased = F.transform(parts, lambda p: F.when(
        (F.upper(p) == p) & (F.length(p) > 1), F.initcap(F.lower(p))
    ).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))))
    return F.array_join(cased, "")


def mint_iri(base: str, cls: Column, key: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), cls, F.lit("/"), key.cast("string"))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based identifier (version 5) from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    v = F.concat(F.lit("5"), F.substring(h, 14, 3))
    top = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), v,
        F.concat(F.lower(F.hex(top)), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def to_boolean(value: Column) -> Column:
    """1, true, yes, y and t are true; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "t"), F.lit(False))


def typed_literal(value: Column, xsd: Column) -> Column:
    """N-Triples literal of a value under its declared type; what doesn't cast stays a string."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    typed = lambda v, t: F.concat(F.lit('"'), v.cast("string"), F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{t}>'))
    return F.coalesce(
        F.when(xsd == "xsd:integer", typed(value.try_cast("long"), "integer")),
        F.when(xsd == "xsd:decimal", typed(value.try_cast("double"), "decimal")),
        F.when(xsd == "xsd:boolean", typed(to_boolean(value), "boolean")),
        F.when(xsd == "xsd:date", typed(value.try_cast("date"), "date")),
        F.when(xsd == "xsd:dateTime", F.concat(F.lit('"'), value, F.lit('"^^<http://www.w3.org/2001/XMLSchema#dateTime>'))),
        quoted,
    )


def parse_time(text: Column) -> Column:
    """ISO-8601 text as a timestamp; what doesn't parse is null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def row_text(cls: str, **columns: Column) -> Column:
    """A row as "class: X | column: value | ..." without nulls."""
    return F.concat_ws(" | ", F.lit(f"class: {cls}"), *[
        F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in columns.items()
    ])


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def half_life(age_days: Column, days: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), age_days / days)
