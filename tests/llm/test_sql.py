"""The SQL of the operators gives their rows."""

import duckdb
import pytest

from cadenza.llm import entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = entry.queries()[name](spark, sf_dir)
    theirs = con.sql(entry.oracle_sql()[name])
    pick = lambda names, rows: sorted(([r[names.index(c)] for c in sorted(names)] for r in rows), key=repr)
    mine, other = pick(frame.columns, [tuple(r) for r in frame.collect()]), pick(theirs.columns, theirs.fetchall())
    assert len(mine) == len(other)
    for a, b in zip(mine, other):
        assert [round(x, 5) if isinstance(x, float) else x for x in a] == [round(x, 5) if isinstance(x, float) else x for x in b]
