"""Every registered query: against its SQL on the smallest tables, and the shape of its plan."""

import re
from pathlib import Path

import pytest

from grantlens.queries import ORACLES, QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def normal(value):
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else value


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([normal(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    cursor = duck.execute(ORACLES[name])
    want = shaped([c[0] for c in cursor.description], cursor.fetchall())
    assert shaped(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF_DIR)).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    text = plan(QUERIES[name](spark, str(SF_DIR)))
    for forbidden in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF"):
        assert forbidden not in text


@pytest.mark.parametrize("name", ["current_version_orders", "exact_dedupe", "postal_rollup", "find_tokens"])
def test_ranked_queries_prune_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, str(SF_DIR)))
    partial = text.index("WindowGroupLimit", text.index("Exchange hashpartitioning"))
    assert "Partial" in text[partial:]


def test_payments_combine_before_their_only_shuffle(spark):
    text = plan(QUERIES["clean_payments"](spark, str(SF_DIR)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min" in text[text.index("Exchange hashpartitioning"):]


def test_feed_shuffles_entities_once(spark):
    text = plan(QUERIES["entity_scores"](spark, str(SF_DIR)))
    keyed = re.findall(r"Exchange hashpartitioning\(entity_key", text)
    assert len(keyed) <= 1
