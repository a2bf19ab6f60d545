"""Relational sources: databases by URL, catalogues, DDL, soft keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: URL scheme -> JDBC prefix and driver class.
DRIVERS = {
    "sqlite": ("jdbc:sqlite:", "org.sqlite.JDBC"),
    "postgresql": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("jdbc:oracle:thin:@", "oracle.jdbc.OracleDriver"),
    "db2": ("jdbc:db2://", "com.ibm.db2.jcc.DB2Driver"),
}
#: SQL type (without size) -> Spark type.
SQL_TYPES = {
    "int": T.LongType(), "integer": T.LongType(), "bigint": T.LongType(), "smallint": T.LongType(), "serial": T.LongType(),
    "bigserial": T.LongType(), "real": T.DoubleType(), "float": T.DoubleType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "bit": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampNTZType(), "datetime": T.TimestampNTZType(),
    "datetime2": T.TimestampNTZType(), "blob": T.BinaryType(), "bytea": T.BinaryType(), "varbinary": T.BinaryType(),
}


def jdbc_options(url: str) -> dict[str, str]:
    """Spark's JDBC options for scheme://[user[:password]@]host[:port]/database (sqlite:path)."""
    scheme, _, rest = url.partition(":")
    scheme = {"postgres": "postgresql", "sqlserver": "mssql"}.get(scheme, scheme)
    if scheme not in DRIVERS:
        raise ValueError(f"unknown database {scheme!r}")
    prefix, driver = DRIVERS[scheme]
    rest = rest.lstrip("/") if scheme != "sqlite" else rest.removeprefix("//")
    user, at, host = rest.rpartition("@")
    out = {"url": prefix + (host if at else rest), "driver": driver}
    if scheme == "mssql" and "/" in out["url"][len(prefix):]:
        server, _, base = out["url"][len(prefix):].partition("/")
        out["url"] = f"{prefix}{server};databaseName={base}"
    if at:
        name, _, password = user.partition(":")
        out |= {"user": name} | ({"password": password} if password else {})
    return out


def read_database(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table by JDBC; split = (column, lowest, highest, parts) reads it in parallel, filters are pushed down."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url)).option("dbtable", table)
    if split:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), split, strict=True):
            reader = reader.option(k, str(v))
    return reader.load()


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    """(table, column, type, nullable) from schemas alone."""
    return [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in sorted(tables.items()) for f in df.schema]


def probe(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Up to most distinct values of a column (a catalogue's sample)."""
    return df.select(column).distinct().limit(most)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): rows of each table, from the formats' statistics where they have them."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, order: list[str], most: int = 5) -> DataFrame:
    """A table's first rows as JSON, with their rank: what a catalogue shows."""
    some = df.orderBy(*order).limit(most).withColumn("_json", F.to_json(F.struct(*df.columns)))
    return some.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("_json").alias("record"))  # most rows at most


def found_keys(tables: dict[str, DataFrame], unique: dict[str, str], least: int = 2) -> DataFrame:
    """(table_name, column_name, target, key): columns all of whose values a table's key has, found from the rows.

    unique names each target's key. Columns are compared with keys of their own type that share the last part of the name
    (l_orderkey, o_orderkey); a column with fewer than ``least`` different values isn't judged. One anti join for each pair.
    """
    end = lambda c: c.split("_", 1)[-1].lower()
    parts = []
    for target, key in sorted(unique.items()):
        keys = tables[target].select(F.col(key).alias("k")).distinct()
        kind = dict(tables[target].dtypes)[key]
        for name, df in sorted(tables.items()):
            for c, t in df.dtypes:
                if name != target and t == kind and end(c) == end(key):
                    mine = df.select(F.col(c).alias("k")).filter("k is not null").distinct()
                    got = mine.join(keys.withColumn("hit", F.lit(True)), "k", "left").agg(
                        F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("lost")).filter((F.col("n") >= least) & (F.col("lost") == 0))
                    parts.append(got.select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(target).alias("target"), F.lit(key).alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def parse_type(text: str) -> T.DataType:
    """Spark's type for an SQL type; what isn't known is a string."""
    t = text.strip().lower()
    m = re.match(r"([a-z0-9_]+)\s*(?:\(([^)]*)\))?", t)
    if not m:
        return T.StringType()
    if m[1] in ("numeric", "decimal", "number"):
        if not m[2]:
            return T.DoubleType()
        p, *s = [int(x) for x in m[2].split(",")]
        return T.DecimalType(min(p, 38), s[0] if s else 0)
    return SQL_TYPES.get(m[1], T.StringType())


def _parts(body: str) -> list[str]:
    """Comma-separated parts outside parentheses and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(body[at:i])
            at = i + 1
    return [p.strip() for p in [*out, body[at:]] if p.strip()]


def import_ddl(sql: str) -> dict[str, dict]:
    """Tables of CREATE TABLE statements: columns (name, type, nullable), primary key, foreign keys (column, table, column)."""
    sql = re.sub(r"--[^\n]*|/\*.*?\*/", "", sql, flags=re.S)
    name = lambda s: re.sub(r'[`"\[\]]', "", s.strip()).split(".")[-1]
    out: dict[str, dict] = {}
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.`\"\[\]]+)\s*\(", sql, re.I):
        depth, end = 1, m.end()
        while depth and end < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        t: dict = {"columns": [], "key": [], "foreign": []}
        for part in _parts(sql[m.end() : end - 1]):
            body = re.sub(r"^constraint\s+\S+\s+", "", part, flags=re.I)
            if k := re.match(r"primary\s+key\s*\(([^)]*)\)", body, re.I):
                t["key"] = [name(c) for c in k[1].split(",")]
            elif k := re.match(r"foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.`\"\[\]]+)\s*\(([^)]*)\)", body, re.I):
                t["foreign"] += [(name(a), name(k[2]), name(b)) for a, b in zip(k[1].split(","), k[3].split(","), strict=True)]
            elif not re.match(r"(?:unique|check|key|index|exclude)\b", body, re.I):
                c = re.match(r"([\w`\"\[\]]+)\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)(.*)", body, re.S)
                if not c:
                    continue
                rest = c[3].lower()
                primary = "primary key" in rest
                t["columns"].append((name(c[1]), parse_type(c[2]), not ("not null" in rest or primary)))
                if primary:
                    t["key"] = [name(c[1])]
                if k := re.search(r"references\s+([\w.`\"\[\]]+)\s*(?:\(([^)]*)\))?", c[3], re.I):
                    t["foreign"].append((name(c[1]), name(k[1]), name(k[2]) if k[2] else "id"))
        out[name(m[1])] = t
    return out


def schema_of(ddl: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in ddl["columns"]])


def soft_keys(columns: DataFrame) -> DataFrame:
    """columns(table_name, column_name): foreign keys guessed from x_id names, with confidence by how the table is named."""
    stem = F.regexp_extract("column_name", r"^(\w+)_id$", 1)
    tables = columns.select(F.col("table_name").alias("target")).distinct()
    guess = lambda name, conf: F.struct(name.alias("target"), F.lit(conf).alias("confidence"))
    s = F.col("stem")
    names = F.array(
        guess(s, 0.85), guess(F.concat(s, F.lit("s")), 0.75), guess(F.concat(s, F.lit("es")), 0.75), guess(F.regexp_replace(s, "s$", ""), 0.60))
    x = columns.withColumn("stem", stem).filter("stem <> ''").select("table_name", "column_name", F.explode(names).alias("g"))
    best = x.select("table_name", "column_name", "g.*").join(tables, "target").filter("target <> table_name")
    return best.groupBy("table_name", "column_name").agg(
        F.max_by("target", "confidence").alias("target"), F.max("confidence").alias("confidence"))
