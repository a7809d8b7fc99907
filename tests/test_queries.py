"""Every registered query against its oracle SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(rows):
    def one(value):
        if value is None:
            return "-"
        return repr(round(value, 9)) if isinstance(value, float) else str(value)

    return sorted(tuple(one(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = canonical(df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    wanted = ", ".join(f'"{c}"' for c in columns)
    assert rows == canonical(duck.execute(f"SELECT {wanted} FROM ({sql})").fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["language", "family", "hits", "max_severity"]
