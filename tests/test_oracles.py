"""Every registered query with oracle SQL gives DuckDB's rows on the small tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from flowledger.plans import queries as history


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(plain(r[i])).removesuffix(".0") for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(history.ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    ours = history.QUERIES[name](spark, sf_dir)
    theirs = duck.execute(history.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert bag(ours.columns, [tuple(r) for r in ours.collect()]) == bag(names, theirs.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(history.QUERIES) <= set(__spark_entry__.queries())
