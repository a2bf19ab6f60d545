"""Log sources: lines of text become one record schema, whatever the format.

Formats are JSON lines, RFC 5424 and BSD syslog, CEF, OTLP spans and custom
patterns with named groups. Parsing is built-in expressions only, so a scan of
many files stays in generated code and a line never reaches Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Confidence by format and severity.
JSON_CONFIDENCE = {"CRITICAL": 0.95, "ERROR": 0.85, "WARNING": 0.70, "WARN": 0.70, "INFO": 0.55, "DEBUG": 0.35, "TRACE": 0.25}
SYSLOG_CONFIDENCE = {"0": 1.0, "1": 1.0, "2": 0.95, "3": 0.90, "4": 0.75, "5": 0.60, "6": 0.50, "7": 0.35}
CEF_CONFIDENCE = {
    "10": 1.0, "9": 1.0, "8": 0.90, "7": 0.85, "6": 0.75, "5": 0.70, "4": 0.60, "3": 0.55, "2": 0.40, "1": 0.35, "0": 0.30,
}
BSD_CONFIDENCE, PLAIN_CONFIDENCE, OTHER_CONFIDENCE, OTLP_CONFIDENCE, PATTERN_CONFIDENCE = 0.55, 0.40, 0.50, 0.80, 0.60
#: Keys by order of preference, suffixes of log files, severities that make an event.
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp")
MESSAGE_KEYS = ("message", "msg", "text")
LEVEL_KEYS = ("level", "severity", "loglevel")
HOST_KEYS = ("host", "hostname")
SERVICE_KEYS = ("service", "app", "source")
VALUE_KEYS = ("value", "metric_value", "metric", "count", "duration_ms")
LOG_SUFFIXES = ("log", "jsonl", "json", "txt", "cef", "syslog", "ndjson")

SEVERE = ("0", "1", "2", "3", "CRITICAL", "ALERT", "ERROR", "EMERGENCY", "EMERG", "CRIT")

SYSLOG_5424 = r"^<(\d+)>\d+\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
SYSLOG_BSD = r"^(?:<\d+>)?(\w{3}\s+\d+\s+[\d:]+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$"
CEF = r"^.*?CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
CEF_PAIR = r"(\w+)=((?:[^=\\]|\\.)*?)(?=\s+\w+=|$)"

FIELDS = (
    "timestamp", "message", "severity", "host", "app", "pid", "value", "unit", "confidence", "fields", "format",
)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all log files below a folder: source_file, line_no (from 1 in each file), raw.

    A line's number is its place in the file: ranges of a file's splits are
    counted first, so that files of any size are numbered over many tasks.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.{" + ",".join(LOG_SUFFIXES) + "}"
    ).text(folder)
    block = F.col("_metadata.file_block_start")
    x = lines.select(
        F.col("_metadata.file_path").alias("source_file"), block.alias("block"), F.col("value").alias("raw"),
        F.monotonically_increasing_id().alias("at"),  # rises within a split, which one task reads in order
    )
    n = x.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = W.partitionBy("source_file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    y = x.join(n, ["source_file", "block"])
    return y.select("source_file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "raw")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def confidence_of(severity: Column, known: dict[str, float], default: float = OTHER_CONFIDENCE) -> Column:
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, severity), F.lit(default))


def record(fmt: str, fields: Column | None = None, **given: Column) -> Column:
    """A record of FIELDS: what isn't given is null."""
    kinds = {"value": "double", "confidence": "double"}
    given |= {"format": F.lit(fmt), "fields": fields if fields is not None else F.lit(None).cast("map<string,string>")}
    return F.struct(*[given.get(f, F.lit(None).cast(kinds.get(f, "string"))).alias(f) for f in FIELDS])


def _json(raw: Column, *keys: str) -> Column:
    return first_filled(*[F.get_json_object(raw, f"$['{k}']") for k in keys])


def _json_fields(raw: Column) -> Column:
    """Keys and values of a JSON object; null where raw isn't one."""
    return F.from_json(raw, "map<string,string>")


def parse_jsonl(raw: Column) -> Column:
    """Null for a line that isn't a JSON object."""
    fields = _json_fields(raw)
    level = F.upper(_json(raw, *LEVEL_KEYS))
    value = F.coalesce(*[F.get_json_object(raw, f"$['{k}']").try_cast("double") for k in VALUE_KEYS])
    return F.when(fields.isNotNull(), record(
        "jsonl", fields, timestamp=_json(raw, *TIME_KEYS), message=_json(raw, *MESSAGE_KEYS), severity=level,
        host=_json(raw, *HOST_KEYS), app=_json(raw, *SERVICE_KEYS), value=value,
        unit=F.when(value.isNotNull(), F.coalesce(F.get_json_object(raw, "$.unit"), F.lit(""))),
        confidence=confidence_of(level, JSON_CONFIDENCE),
    ))


def parse_syslog(raw: Column) -> Column:
    """RFC 5424, else BSD, else a plain line."""
    new, old = raw.rlike(SYSLOG_5424), raw.rlike(SYSLOG_BSD)
    part = lambda i, j: F.nullif(
        F.when(new, F.regexp_extract(raw, SYSLOG_5424, i)).when(old, F.regexp_extract(raw, SYSLOG_BSD, j)), F.lit("")
    )
    level = F.when(new, F.regexp_extract(raw, SYSLOG_5424, 1).try_cast("int").bitwiseAND(7).cast("string"))
    return record(
        "syslog", timestamp=part(2, 1), message=F.coalesce(part(7, 5), raw), severity=level, host=part(3, 2), app=part(4, 3),
        pid=part(5, 4),
        confidence=F.when(new, confidence_of(level, SYSLOG_CONFIDENCE)).when(old, BSD_CONFIDENCE).otherwise(PLAIN_CONFIDENCE),
    )


def parse_cef(raw: Column) -> Column:
    """Null for a line without a CEF header; text before the header is allowed."""
    ok = raw.rlike(CEF)
    part = lambda i: F.regexp_extract(raw, CEF, i)
    keys = F.regexp_extract_all(part(8), F.lit(CEF_PAIR), 1)
    values = F.transform(F.regexp_extract_all(part(8), F.lit(CEF_PAIR), 2), lambda v: F.trim(v))
    # the last of repeated keys counts
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    fields = F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.map_from_entries(F.array(p))),
    )
    ext = lambda *names: first_filled(*[F.try_element_at(fields, F.lit(k)) for k in names])
    return F.when(ok, record(
        "cef", fields, timestamp=ext("rt", "end", "start"), message=part(6), severity=part(7), host=ext("dhost", "shost"),
        app=part(3), confidence=confidence_of(F.trim(part(7)), CEF_CONFIDENCE),
    ))


def parse_otlp(raw: Column) -> Column:
    """A span: its duration in milliseconds is the value. Null for a line that isn't one."""
    fields = _json_fields(raw)
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    start, end = (at(k).try_cast("decimal(20,0)") for k in ("startTimeUnixNano", "endTimeUnixNano"))
    value = F.when((start != 0) & (end != 0), ((end - start) / F.lit(1000000)).cast("double"))
    span = F.map_contains_key(fields, "traceId") | F.map_contains_key(fields, "resourceSpans")
    return F.when(span, record(
        "otlp", fields, timestamp=at("startTimeUnixNano"), message=first_filled(at("name"), at("kind"), F.lit("span")),
        severity=F.lit("INFO"), value=value, unit=F.when(value.isNotNull(), F.lit("ms")), confidence=F.lit(OTLP_CONFIDENCE),
    ))


def parse_auto(raw: Column) -> Column:
    """Format by the line's look; spans are told from other JSON by their keys."""
    return F.when(raw.startswith("{"), F.coalesce(parse_otlp(raw), parse_jsonl(raw))).when(
        raw.contains("CEF:"), parse_cef(raw)).otherwise(parse_syslog(raw))


def parse_custom(raw: Column, pattern: str) -> Column:
    """A record from a pattern's named groups; null where it doesn't match."""
    got = parse_pattern(raw, pattern)
    at = lambda k: F.try_element_at(got, F.lit(k))
    return F.when(got.isNotNull(), record(
        "regex", got, message=F.coalesce(at("message"), raw), timestamp=at("timestamp"),
        severity=F.upper(F.coalesce(at("severity"), F.lit("INFO"))), confidence=F.lit(PATTERN_CONFIDENCE),
    ))


def parse_pattern(raw: Column, pattern: str) -> Column:
    """Map of a pattern's named groups ((?P<name>...)), without empty ones."""
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    order = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.regexp_extract(raw, plain, order[n]).alias("value")) for n in names])
    return F.when(raw.rlike(plain), F.map_from_entries(F.filter(pairs, lambda p: p["value"] != "")))


def parse(lines: DataFrame, fmt: str = "auto", column: str = "raw", pattern: str | None = None) -> DataFrame:
    """Adds the record's fields to lines; empty lines and lines that the format can't read are dropped."""
    raw = F.trim(F.col(column))
    parsers = {"auto": parse_auto, "jsonl": parse_jsonl, "syslog": parse_syslog, "cef": parse_cef, "otlp": parse_otlp}
    found = parse_custom(raw, pattern) if fmt == "regex" else parsers[fmt](raw)
    x = lines.filter(raw != "").withColumn("_r", found).filter("_r is not null")
    return x.select("*", "_r.*").drop("_r")


def route(records: DataFrame, entities: list[str]) -> DataFrame:
    """Adds route: observation (a value), event (severe), observation (an entity is named), else rejected."""
    named = F.lit(False)
    for e in entities:
        named = named | F.lower(F.coalesce("message", F.lit(""))).contains(e.lower())
    return records.withColumn(
        "route",
        F.when(F.col("value").isNotNull(), "observation").when(F.col("severity").isin(*SEVERE), "event")
        .when(named & (F.length("message") > 3), "observation").otherwise("rejected"),
    )
