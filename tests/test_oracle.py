"""Every query with an oracle gives DuckDB's rows on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from cadenza.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 5)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, sf_dir, name):
    frame = registry.queries()[name](spark, sf_dir)
    theirs = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(theirs.columns)
    mine = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    other = _rows(theirs.columns, theirs.fetchall())
    assert len(mine) == len(other)
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    assert not wrong, wrong[:3]
