"""Reading and writing history snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import KEYS, TABLES, checked

#: The column that a live table's rows are dealt out by, and that its snapshot's files are ranged by beyond the key.
BY_TIME = {"workflow_status": "created_at", "notifications": "created_at_epoch_ms", "application_versions": "created_at", "queues": "created_at"}
ROWS_A_FILE = 5_000_000


def read_snapshot(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a Parquet snapshot, its schema checked and registered as a view of that name."""
    df = checked(spark.read.parquet(f"{folder}/{table}"), table, *([] if version is None else [version]))
    df.createOrReplaceTempView(table)
    return df


def write_snapshot(df: DataFrame, folder: str, table: str, ranged: bool = True, rows_a_file: int = ROWS_A_FILE) -> None:
    """A new snapshot; ``folder`` must not be the one that ``df`` reads.

    Rows are ranged and sorted by the table's key, so that a point lookup or a
    range of ids reads few row groups, and joins by the key read files that hold
    few others.  ``ranged=False`` writes rows as they come, without a shuffle.
    """
    own = checked(df, table)
    if ranged:
        own = own.repartitionByRange(*KEYS[table]).sortWithinPartitions(*KEYS[table])
    own.write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file).parquet(f"{folder}/{table}")


def jdbc_options(url: str, table: str, schema: str, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> dict[str, str]:
    """What ``read_live`` asks for; with ``bounds`` (of the table's time, in epoch milliseconds) the read is dealt out to ``parts`` connections."""
    names = ", ".join(f'"{c}"' for c in TABLES[table].names)
    out = {"url": url, "dbtable": f'(SELECT {names} FROM "{schema}"."{table}") AS t', "fetchsize": "10000", **options}
    if bounds is not None:
        if table not in BY_TIME:
            raise ValueError(f"{table} has no time to deal its rows out by")
        low, high = bounds
        if low >= high:
            raise ValueError("the lower bound must be less than the upper one")
        out |= {"partitionColumn": BY_TIME[table], "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def read_live(spark: SparkSession, url: str, table: str, schema: str, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table of a live system database over JDBC (needs its driver); filters and columns are pushed down.

    Bounds only deal rows out; rows beyond them are read, too, by the first and last connection.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, table, schema, bounds, parts, **options)).load()
