"""Conflicts between observations and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .range_join import band_join

#: How values were derived, the most trusted first.
DERIVATION = ("MEASURED", "INFERRED", "IMPORTED", "SYNTHESIZED", "DEFAULT")


def kpi_pairs(records: DataFrame, keys: list[str], at: str, value: str, width: float, share: float) -> DataFrame:
    """Pairs (a earlier id) of equal keys within width that differ by more than a share of a's value."""
    cols = ["record", *keys, at, value, "method"]
    x = band_join(records.select(*cols), records.select(*cols), keys, at, width)
    x = x.filter((F.col("record") < F.col("r_record")) & (F.abs(F.col(value) - F.col(f"r_{value}")) > share * F.col(value)))
    return x.withColumnsRenamed({"record": "a", "r_record": "b", "method": "method_a", "r_method": "method_b"})


def priority(method: Column) -> Column:
    out = F.lit(len(DERIVATION) - 1)
    for i, m in enumerate(DERIVATION):
        out = F.when(method == m, i).otherwise(out)
    return out


def resolve(pairs: DataFrame) -> DataFrame:
    """The better derived side of each pair, a on ties."""
    return pairs.select(
        "a", "b", F.when(priority(F.col("method_b")) < priority(F.col("method_a")), F.col("b")).otherwise(F.col("a")).alias("winner")
    )


#: Rules that rows of the domain must keep: rule -> (table, key, what breaks it).
CONSISTENCY = {
    "T1-RES-STATE-01": ("resource", "resource_iri", "operational_state = 'Disabled' and admin_state = 'Unlocked'"),
    "T1-ALARM-CLEARED-01": ("alarm", "alarm_iri", "alarm_state = 'Cleared' and cleared_at is null"),
    "T1-BILL-DUE-01": ("customer_bill", "bill_number", "amount_due < 0 and bill_type <> 'CreditNote'"),
    "T1-TICKET-RESOLVE-01": ("trouble_ticket", "ticket_iri", "status in ('Resolved', 'Closed') and resolved_at is null"),
}
CONFLICT_RULE, WINDOW_SECONDS, SHARE, LEAST = "T1-CONFLICT-TIER2-01", 300.0, 0.10, 2


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, key) of the rows of tables(name -> rows) that break a rule; absent tables break none."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "rule_id string, key string")
    for rule, (name, key, breaks) in CONSISTENCY.items():
        if name in tables:
            hit = tables[name].filter(breaks).select(F.lit(rule).alias("rule_id"), F.col(key).cast("string").alias("key"))
            out = out.unionByName(hit)
    return out


def measurement_conflicts(records: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Keys under which at least two measurements of five minutes differ by a tenth of the one: (keys, n, lo, hi), both ways counted."""
    cols = ["record", *keys, at, value]
    x = band_join(records.select(*cols), records.select(*cols), keys, at, WINDOW_SECONDS)
    x = x.filter((F.col("record") != F.col("r_record")) & (F.abs(F.col(value) - F.col(f"r_{value}")) > SHARE * F.col(value)))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).filter(F.col("n") >= LEAST)


def open_escalations(conflicts: DataFrame) -> DataFrame:
    """Conflicts that wait for a person."""
    return conflicts.filter("status = 'Escalated' and escalated_to_human")
