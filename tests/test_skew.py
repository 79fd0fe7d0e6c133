"""A key that holds a third of the rows: joins split it, lists and pages stay bounded."""

from contextlib import contextmanager
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from grantlens.operators import audits, dossier, guards, scoring, text_checks

# Small enough for a test's partitions to count as skewed.
TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=6000):
    """Numbers with a key that a third of the rows share; every other key is rare."""
    df = spark.range(n).repartition(6)
    return df.withColumn("key", F.when(F.rand(7) < 0.34, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997)))


def test_scores_split_a_shared_entity_key(spark):
    with settings(spark, TINY):
        e = hot(spark).select(
            F.concat(F.lit("e"), "id").alias("id"), F.lit("n").alias("canonical_name"), F.col("key").alias("bn_root"),
            F.array(F.lit("fed")).alias("dataset_sources"),
        )
        keys = hot(spark).select("key").distinct()
        totals = keys.select(F.col("key").alias("recipient_key"), F.lit(5_000_000).alias("total_commitment"), F.lit(1).alias("agreement_count"))
        loops = keys.select(F.col("key").alias("bn"), F.lit(8).alias("score"), F.lit(6).alias("total_loops"))
        violations = hot(spark).select(F.col("key").alias("bn"))
        rows, text = final_plan(scoring.score_entities(e, totals, loops, violations))
    assert len(rows) == 6000 and {r.composite_score for r in rows} == {2 + 2 + 3 + 3}
    assert "SortMergeJoin(skew=true)" in text


@pytest.mark.parametrize("kind", ["citations", "quotes", "links"])
def test_text_joins_split_a_hot_key(spark, kind):
    with settings(spark, TINY):
        df = hot(spark)
        if kind == "links":
            pages = df.select(F.col("id").alias("page_id"), F.concat(F.lit('<a href="/'), "key", F.lit('">')).alias("html"))
            routes = df.select(F.concat(F.lit("/"), "key").alias("path"))
            rows, text = final_plan(audits.dead_links_table(pages, routes))
            assert rows == []
        else:
            s = df.select(
                F.col("key").alias("brief_id"), F.col("id").alias("sentence_no"), F.lit("He said “so”.").alias("text"), F.array(F.lit("a")).alias("citations")
            )
            if kind == "citations":
                sources = df.select(F.col("key").alias("brief_id"), F.lit("a").alias("source_id"))
                rows, text = final_plan(text_checks.citation_completeness_table(s, sources))
                assert rows == []
            else:
                rows, text = final_plan(text_checks.quote_discipline_table(s))
                assert len(rows) == 6000 - df.select("key").distinct().count()
    assert "SortMergeJoin(skew=true)" in text


def test_current_version_prunes_a_hot_key_in_the_map_tasks(spark):
    df = hot(spark).select(
        F.col("id").alias("_id"), F.col("key").alias("ref_number"), F.lit("1").alias("amendment_number"),
        F.lit("b").alias("recipient_business_number"), F.lit("n").alias("recipient_legal_name"),
    )
    current = guards.current_version(df)
    rows = current.collect()
    want = {r.key: r.m for r in hot(spark).groupBy("key").agg(F.max("id").alias("m")).collect()}
    assert {r.ref_number: r._id for r in rows} == want
    exchanges = [line for line in current._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "WindowGroupLimit" in line]
    assert exchanges


def test_payments_with_one_hot_duplicate(spark):
    base = spark.range(5000).select(
        "id", F.lit("M").alias("ministry"), F.lit("b").alias("business_unit_name"), F.lit("R").alias("recipient"),
        F.lit("P").alias("program"), F.when(F.col("id") % 3 == 0, D("10.00")).otherwise(D("-10.00")).cast("decimal(18,2)").alias("amount"),
        F.lit("2024-01-01").cast("date").alias("payment_date"),
    )
    assert [r.id for r in guards.clean_payments(base).collect()] == [0]


def test_hot_entity_is_split_where_it_meets_its_pages(spark):
    agreements = "agreement_start_date", "agreement_end_date"
    g = hot(spark, 3000).select(
        F.col("id").alias("_id"), F.concat(F.lit("r"), "id").alias("ref_number"), F.lit("").alias("amendment_number"),
        F.col("key").alias("recipient_business_number"), F.lit("n").alias("recipient_legal_name"), F.lit("CA").alias("recipient_country"),
        F.lit("ON").alias("recipient_province"), F.lit(1).cast("decimal(18,2)").alias("agreement_value"),
        *[F.lit("2020-01-01").cast("date").alias(c) for c in agreements], F.lit("d").alias("description_en"),
        F.lit("p").alias("prog_name_en"), F.lit("o").alias("owner_org_title"),
    )
    e = g.select(F.col("recipient_business_number").alias("id"), F.lit("n").alias("canonical_name"), F.col("recipient_business_number").alias("bn_root")).distinct()
    loops = spark.createDataFrame([], "bn string, legal_name string, score int, total_loops int, max_bottleneck decimal(18,2), total_circular_amt decimal(18,2)")
    violations = spark.createDataFrame([], "bn string")
    unnumbered = e.select(F.concat(F.lit("x"), "id").alias("id"), F.lit("nobody").alias("canonical_name"), F.lit(None).cast("string").alias("bn_root"))
    with settings(spark, TINY):
        found = dossier.entity_dossier(e.unionByName(unnumbered.limit(3)), g, violations, loops, page_rows=20)
        nested = dossier.nest_dossiers(found)
        rows = nested.collect()
        plan = nested._jdf.queryExecution().executedPlan().toString()
    assert sum(len(r.agreements) for r in rows) == 3000
    assert max(len(r.agreements) for r in rows) < 60
    counts = {r.key: r.n for r in hot(spark, 3000).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert {r.entity_id: r.fed_summary.agreement_count for r in rows} == counts
    assert "SortMergeJoin(skew=true)" in plan.split("== Initial Plan ==")[0]
    assert "isnull" not in "".join(x for x in plan.splitlines() if "hashpartitioning(_bn" in x)
