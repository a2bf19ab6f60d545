"""Sinks and text targets: triples, statements for graph stores, schemas, detection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def n_triples(triples: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """One line for each triple."""
    iri = lambda c: F.concat(F.lit("<" + base), F.regexp_replace(c, "[ <>\"{}|^`]", "_"), F.lit(">"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    obj = F.when(F.col("o_is_iri"), iri(F.col("o"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), obj, F.lit(".")).alias("value"))


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """parquet, csv (with header), json, or text lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else getattr(writer, fmt)(path)


def _quoted(c):
    return F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))


def cypher(edges: DataFrame) -> DataFrame:
    """edges(src, dst, label): MERGE statements."""
    name = F.upper(F.regexp_replace("label", "[^A-Za-z0-9]+", "_"))
    return edges.select(F.concat(
        F.lit("MERGE (a:Entity {id: "), _quoted(F.col("src")), F.lit("}) MERGE (b:Entity {id: "), _quoted(F.col("dst")),
        F.lit("}) MERGE (a)-[:"), name, F.lit("]->(b);")).alias("statement"))


def graphql(columns: DataFrame) -> DataFrame:
    """columns(table_name, column_name, type, nullable): a GraphQL type for each table."""
    kind = F.when(F.col("type").isin("bigint", "int", "smallint"), "Int").when(
        F.col("type").rlike("^(?:double|float|decimal)"), "Float").when(F.col("type") == "boolean", "Boolean").otherwise("String")
    line = F.concat(F.lit("  "), "column_name", F.lit(": "), kind, F.when(F.col("nullable"), "").otherwise("!"))
    body = columns.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    name = F.regexp_replace(F.initcap(F.regexp_replace("table_name", "_", " ")), " ", "")
    return body.select("table_name", F.concat(F.lit("type "), name, F.lit(" {\n"), "body", F.lit("\n}")).alias("definition"))


def detection_rules(edges: DataFrame, window: int = 60) -> DataFrame:
    """A correlation rule as text for each directed one of edges(src, dst, lead, directed)."""
    return edges.filter("directed").select("src", "dst", F.format_string(
        "rule: %s_then_%s\nwhen: %s followed_by %s within %ds\nconfidence: %.2f", "src", "dst", "src", "dst", F.lit(window), "lead"
    ).alias("rule"))
