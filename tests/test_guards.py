"""Guards, scores and audits on small fixtures."""

import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from grantlens.operators import guards, scoring
from grantlens.sources.tables import register_views, row_count_gate, save_current

GRANTS = (
    "_id bigint, ref_number string, amendment_number string, recipient_business_number string, recipient_legal_name string,"
    " agreement_value decimal(18,2), description_en string"
)


def grants(spark):
    return spark.createDataFrame(
        [
            (1, "r1", "2", "b1", "n", D(10), None),
            (2, "r1", "10", "b1", "n", D(20), "x" * 80),
            (3, "r1", "", "b1", "n", D(30), "x" * 81),
            (4, "r1", None, "b2", "n", D(40), None),
            (5, "r1", "1", None, "n", D(50), None),
            (6, "r1", "1", None, None, D(60), None),
            (7, "r1", "1", None, None, None, None),
            (8, "r2", "3", "b1", "n", D(70), None),
            (9, "r2", "3", "b1", "m", D(80), None),
        ],
        GRANTS,
    )


def test_current_version_orders_numbers_and_keeps_collisions_apart(spark):
    current = guards.current_version(grants(spark))
    assert sorted(r._id for r in current.collect()) == [2, 4, 5, 6, 7, 9]
    again = guards.current_version(current)
    assert sorted(r._id for r in again.collect()) == [2, 4, 5, 6, 7, 9]


def test_description_gaps_boundary(spark):
    rows = guards.description_gaps(grants(spark), min_value=15).collect()
    assert sorted(r._id for r in rows) == [2, 4, 5, 6, 9]


PAYMENTS = "id bigint, ministry string, business_unit_name string, amount decimal(18,2), recipient string, program string, payment_date date"


def payments(spark):
    rows = [
        (1, "M", None, D(100), "R"), (2, "M", None, D(-100), "R"), (3, "M", "b", D(100), "R"), (4, "M", "b", D(-100), "R"),
        (5, "M", "b", D(100), "R"), (6, "M", "b", D(0), "R"), (7, "M", "b", D(50), None), (8, "M", "b", D(-7), "R"), (9, "M", "b", None, "R"),
    ]
    return spark.createDataFrame([(*r, "P", date(2024, 1, 1)) for r in rows], PAYMENTS)


def test_clean_payments_golden(spark):
    kept = guards.clean_payments(payments(spark))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 6, 8, 9]
    safe = guards.clean_payments(payments(spark), null_safe=True)
    assert sorted(r.id for r in safe.collect()) == [1, 3, 6, 8, 9]


def test_payments_shuffle_once(spark):
    plan = guards.clean_payments(payments(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_payments_with_more_columns(spark):
    """Two windows, written out here, and the one aggregate agree, other columns and their order included."""
    rng = random.Random(2)
    rows = [(k, f"note {k}", rng.choice(["M", None]), rng.choice(["b", "c"]), rng.choice(["R", "S", None]), "p", rng.choice([1, -1, 2, -2, 0, None]), rng.choice(["2024-01-01", None]))
            for k in range(400)]
    df = spark.createDataFrame(rows, "id int, note string, ministry string, business_unit_name string, recipient string, program string, amount int, payment_date string")
    for null_safe in (False, True):
        kept = guards.dedupe_exact(guards.exclude_rollups(df), [*guards.PAYMENT_KEYS, "amount"], [F.col("id")])
        flagged = guards.flag_reversals(kept, null_safe=null_safe)
        want = flagged.filter("NOT has_reversal_pair OR amount > 0")
        got = guards.clean_payments(df, null_safe=null_safe)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_positive_row_survives(spark):
    deduped = guards.dedupe_exact(guards.exclude_rollups(payments(spark)), [*guards.PAYMENT_KEYS, "amount"], [F.col("id")])
    positive = {r.id for r in deduped.filter("amount > 0").collect()}
    assert positive <= {r.id for r in guards.clean_payments(payments(spark)).collect()}


def test_omitted_rollup(spark):
    assert tuple(guards.omitted_rollup(payments(spark)).first()) == (1, D("50.00"))


def test_scores_and_null_numbers(spark):
    entities = spark.createDataFrame(
        [("e1", "Alpha", "b1", ["fed", "cra"]), ("e2", "Beta", None, ["fed"]), ("e3", "b1", None, None), ("e4", None, None, None)],
        "id string, canonical_name string, bn_root string, dataset_sources array<string>",
    )
    totals = spark.createDataFrame([("b1", D(200_000_000), 60), ("Beta", D(2_000_000), 11)], "recipient_key string, total_commitment decimal(18,2), agreement_count bigint")
    loops = spark.createDataFrame([("b1", "Alpha", 23, 6)], "bn string, legal_name string, score int, total_loops int")
    violations = spark.createDataFrame([("b1",), ("b1",)], "bn string")
    got = {r.entity_id: r for r in scoring.score_entities(entities, totals, loops, violations).collect()}
    assert got["e1"].composite_score == 6 + 4 + 5 + 3 + 3 + 2 and got["e1"].score_label == "CRITICAL"
    assert got["e1"].arithmetic_violations == 2
    assert got["e2"].composite_score == 2 + 2
    # a name equal to someone's number joins totals, as the coalesced key says, but never loops or violations
    assert got["e3"].composite_score == 6 + 4 and got["e3"].max_loop_score == 0 and got["e3"].arithmetic_violations == 0
    assert got["e4"].composite_score == 0 and got["e4"].score_label == "LOW"


def test_label_audit_golden(spark):
    stored = list(zip([26, 28, 18, 22, 21, 24, 23, 14, 16, 11], ["CRITICAL"] * 2 + ["HIGH"] * 5 + ["MEDIUM"] * 2 + ["LOW"]))
    df = spark.createDataFrame(stored, "score int, score_label string")
    assert sorted(r.score for r in scoring.label_audit(df).collect()) == [11, 14, 16, 22, 23, 24]


def test_amendment_profile(spark):
    row = guards.amendment_profile(grants(spark).filter("recipient_business_number = 'b1' AND ref_number = 'r1'")).first()
    assert (row.versions, row.amendment_count, row.first_value, row.growth) == (3, 2, D("30.00"), D("0.00"))


def test_saved_current_rows_group_without_a_shuffle(spark, tmp_path):
    kept = save_current(guards.current_version(grants(spark)), "current_grants", buckets=4, path=str(tmp_path / "current"))
    grouped = kept.groupBy("ref_number").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert {r.ref_number: r["count"] for r in grouped.collect()} == {"r1": 5, "r2": 1}
    spark.sql("DROP TABLE current_grants")


def test_tables_and_gate(spark, tmp_path):
    for name, n in (("fed/a", 3), ("cra/a", 5)):
        spark.range(n).write.parquet(str(tmp_path / f"{name}.parquet"))
    frames = register_views(spark, str(tmp_path), ["fed.a", "cra.a"], search_path=["cra", "fed"])
    assert spark.table("a").count() == 5 and spark.table("fed_a").count() == 3
    gate = {r.label: r.passed for r in row_count_gate(frames, {"fed.a": 4, "cra.a": 5}).collect()}
    assert gate == {"fed.a": False, "cra.a": True}
