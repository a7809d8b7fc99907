"""Every registered query of this folder runs over whole tables; those with oracle SQL agree with it."""

import pytest

from wardline.llm.oracles import ORACLES
from wardline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS = {"op5_chat_repair": "conversations"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == con.execute(f"SELECT count(*) FROM {ROWS.get(name, 'documents')}").fetchone()[0]
    if name in ORACLES:
        wanted = ", ".join(f'"{c}"' for c in columns)
        assert sorted(map(repr, rows)) == sorted(map(repr, con.execute(f"SELECT {wanted} FROM ({ORACLES[name]})").fetchall()))
