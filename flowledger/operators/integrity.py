"""Assertions in place of database constraints: each returns the rows that break one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHILDREN, KEYS


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def duplicate_dedups(ws: DataFrame) -> DataFrame:
    return duplicate_keys(ws.where(F.col("deduplication_id").isNotNull() & F.col("queue_name").isNotNull()), ["queue_name", "deduplication_id"])


def orphan_rows(child: DataFrame, ws: DataFrame, key: str = "workflow_uuid") -> DataFrame:
    return child.join(ws.select(F.col("workflow_uuid").alias(key)), key, "left_anti").select(key).distinct()


def both_or_neither(oo: DataFrame) -> DataFrame:
    """Steps that don't have exactly one of output and error."""
    return oo.where(F.col("output").isNull() == F.col("error").isNull()).select("workflow_uuid", "function_id")


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) for each table's key, each child's parent, deduplication ids, and steps' output or error."""
    parts = [(f"{n}: key", duplicate_keys(df, KEYS[n])) for n, df in tables.items()]
    parts += [(f"{n}: parent", orphan_rows(df, tables["workflow_status"], CHILDREN[n])) for n, df in tables.items() if n in CHILDREN and "workflow_status" in tables]
    if "workflow_status" in tables:
        parts.append(("workflow_status: deduplication", duplicate_dedups(tables["workflow_status"])))
    if "operation_outputs" in tables:
        parts.append(("operation_outputs: output or error", both_or_neither(tables["operation_outputs"])))
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in parts])
