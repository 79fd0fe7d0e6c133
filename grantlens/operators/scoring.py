"""Composite risk score, the ranked findings feed, and score audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.provenance import WEIGHT_DIMENSIONS, WEIGHTS_TYPE, encode_weights, rescore
from ..functions.scalar import capped_sum, int_quotient, matching_number, score_label, step_score
from .guards import current_version, recipient_totals
from .skew import reduce_by


@dataclass(frozen=True)
class ScoreRules:
    """Thresholds and points of the composite score."""

    commitment: Sequence[tuple[float, int]] = ((100_000_000, 6), (10_000_000, 4), (1_000_000, 2))
    agreements: Sequence[tuple[float, int]] = ((50, 4), (10, 2))
    loop_divisor: int = 4
    loops: Sequence[tuple[float, int]] = ((5, 3),)
    violations: Sequence[tuple[float, int]] = ((0, 3),)
    coverage: tuple[str, str] = ("fed", "cra")
    coverage_points: int = 2
    cap: int = 30


def violation_counts(violations: DataFrame, bn: str = "bn") -> DataFrame:
    return reduce_by(violations.select(F.col(bn).alias("bn")), ["bn"], F.count("*").alias("arithmetic_violations"))


def score_entities(
    entities: DataFrame,
    totals: DataFrame,
    loops: DataFrame,
    violations: DataFrame,
    rules: ScoreRules = ScoreRules(),
) -> DataFrame:
    """Composite score of every entity.

    Totals, loops and violations are first merged into one row of facts per key; loops hold one row
    per number. The entities then shuffle once, on their coalesced key, which keeps those without a
    business number from gathering on NULL, and a key shared by many entities can be split. Loops
    and violations only ever count for a real business number.
    """
    counts = violation_counts(violations).withColumnRenamed("bn", "fact_key")
    loop_rows = loops.select(F.col("bn").alias("fact_key"), "score", "total_loops")
    facts = (
        totals.withColumnRenamed("recipient_key", "fact_key")
        .join(loop_rows, "fact_key", "full")
        .join(counts, "fact_key", "full")
    )
    has_bn = F.col("bn_root").isNotNull()
    e = entities.withColumn("entity_key", F.coalesce("bn_root", "canonical_name"))
    joined = e.join(facts, F.col("entity_key") == F.col("fact_key"), "left").withColumns(
        {c: F.when(has_bn, F.col(c)) for c in ("score", "total_loops", "arithmetic_violations")}
    )
    both_covered = F.lit(True)
    for source in rules.coverage:
        both_covered = both_covered & F.array_contains("dataset_sources", source)
    terms = [
        step_score("total_commitment", rules.commitment),
        step_score("agreement_count", rules.agreements),
        F.coalesce(int_quotient("score", rules.loop_divisor), F.lit(0)),
        step_score("total_loops", rules.loops),
        step_score("arithmetic_violations", rules.violations),
        F.when(both_covered, F.lit(rules.coverage_points)).otherwise(F.lit(0)),
    ]
    return joined.select(
        F.col("id").alias("entity_id"),
        "canonical_name",
        "bn_root",
        "dataset_sources",
        F.coalesce("total_commitment", F.lit(0)).alias("fed_total_commitment"),
        F.coalesce("agreement_count", F.lit(0)).alias("fed_agreement_count"),
        F.coalesce("score", F.lit(0)).alias("max_loop_score"),
        F.coalesce("total_loops", F.lit(0)).alias("loop_count"),
        F.coalesce("arithmetic_violations", F.lit(0)).alias("arithmetic_violations"),
        capped_sum(terms, rules.cap).cast("int").alias("composite_score"),
    ).withColumn("score_label", score_label("composite_score"))


def findings_feed(
    entities: DataFrame,
    grants: DataFrame,
    loops: DataFrame,
    violations: DataFrame,
    limit: int = 50,
    floor: int = 10,
    rules: ScoreRules = ScoreRules(),
    by_root: bool = False,
) -> DataFrame:
    """Entities at or above the score floor, highest first; ties end on the entity id.

    by_root adds up commitments by the nine-digit root of the recipient's number.
    """
    current = current_version(grants)
    bn = "recipient_business_number"
    totals = recipient_totals(current.withColumn(bn, matching_number(bn, by_root)))
    scored = score_entities(entities, totals, loops, violations, rules)
    return (
        scored.filter(F.col("composite_score") >= floor)
        .orderBy(
            F.col("composite_score").desc(),
            F.col("fed_total_commitment").desc_nulls_last(),
            F.col("entity_id"),
        )
        .limit(limit)
    )


def label_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score_label").agg(F.count("*").alias("entities"))


def label_audit(df: DataFrame, score: str = "score", stored: str = "score_label") -> DataFrame:
    """Rows whose stored label is not the one their score calls for."""
    derived = df.withColumn("derived_label", score_label(score))
    return derived.filter(~F.col(stored).eqNullSafe(F.col("derived_label")))


def rescore_sensitivity(df: DataFrame, weights: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """One row per token and weight vector of the same key, with the re-scored value and label.

    weights has a column per dimension and the key columns; it may hold any number of vectors. To try
    all vectors on every token, give both sides the key that says so.
    """
    names = [n for n, _, _ in WEIGHT_DIMENSIONS]
    vectors = weights.select(*by, F.struct(*[F.col(n).cast("int").alias(n) for n in names]).cast(WEIGHTS_TYPE).alias("weights"))
    return (
        df.join(vectors, list(by))
        .withColumn("weights_code", encode_weights("weights"))
        .withColumn("new_score", rescore(score, "weights"))
        .withColumn("new_label", score_label("new_score"))
    )
