"""Queries that SQL can express, against DuckDB."""

import pytest

from grantlens.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*names).collect()) == plain(cursor.fetchall())
