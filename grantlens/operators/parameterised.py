"""The feed, the postal look-up and the clean payments as SQL with named parameters, over tables named by schema.

For users who keep their work in SQL: each text takes its values through spark.sql(text, args=...), never by
pasting, and tables come from the catalog (sources.tables.register_schemas, or any other). Rules and thresholds
are those of the operators, and so are the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import LOWEST_LABEL, SCORE_LABELS
from .dossier import FUNDING_FIELDS
from .guards import PAYMENT_KEYS
from .scoring import ScoreRules


def _steps(value: str, steps) -> str:
    """Points of the first threshold that a value exceeds."""
    return "CASE " + " ".join(f"WHEN {value} > {threshold} THEN {points}" for threshold, points in steps) + " ELSE 0 END"


def _feed(rules: ScoreRules) -> str:
    covered = " AND ".join(f"array_contains(dataset_sources, '{source}')" for source in rules.coverage)
    points = [
        _steps("fed_total_commitment", rules.commitment), _steps("fed_agreement_count", rules.agreements),
        f"max_loop_score div {rules.loop_divisor}", _steps("loop_count", rules.loops), _steps("arithmetic_violations", rules.violations),
        f"CASE WHEN {covered} THEN {rules.coverage_points} ELSE 0 END",
    ]
    label = "CASE " + " ".join(f"WHEN composite_score >= {least} THEN '{name}'" for least, name in SCORE_LABELS) + f" ELSE '{LOWEST_LABEL}' END"
    return f"""
WITH versions AS (
    SELECT *, row_number() OVER (
        PARTITION BY ref_number, coalesce(recipient_business_number, recipient_legal_name, string(_id))
        ORDER BY try_cast(nullif(amendment_number, '') AS int) DESC NULLS LAST, _id DESC) AS nth
    FROM fed.grants_contributions),
totals AS (
    SELECT coalesce(recipient_business_number, recipient_legal_name) AS recipient, sum(agreement_value) AS commitment, count(*) AS agreements
    FROM versions WHERE nth = 1 AND agreement_value IS NOT NULL GROUP BY ALL),
broken AS (SELECT bn, count(*) AS violations FROM cra.t3010_impossibilities GROUP BY bn),
facts AS (
    SELECT e.id AS entity_id, e.canonical_name, e.bn_root, e.dataset_sources,
        coalesce(t.commitment, 0) AS fed_total_commitment, coalesce(t.agreements, 0) AS fed_agreement_count,
        coalesce(l.score, 0) AS max_loop_score, coalesce(l.total_loops, 0) AS loop_count, coalesce(b.violations, 0) AS arithmetic_violations
    FROM general.entity_golden_records e
    LEFT JOIN totals t ON t.recipient = coalesce(e.bn_root, e.canonical_name)
    LEFT JOIN cra.loop_universe l ON l.bn = e.bn_root
    LEFT JOIN broken b ON b.bn = e.bn_root),
scored AS (SELECT *, int(least({rules.cap}, {' + '.join(points)})) AS composite_score FROM facts)
SELECT *, {label} AS score_label FROM scored WHERE composite_score >= :floor
ORDER BY composite_score DESC, fed_total_commitment DESC NULLS LAST, entity_id LIMIT :limit"""


_FUNDING = " + ".join(f"coalesce(try_cast(get_json_object({profile}, '$.{field}') AS decimal(38,6)), 0)" for profile, field in FUNDING_FIELDS)
POSTAL = f"""
SELECT id, canonical_name, bn_root, dataset_sources, CAST({_FUNDING} AS decimal(38,6)) AS total_external_funding
FROM general.entity_golden_records
WHERE exists(addresses, a -> replace(upper(a.postal_code), ' ', '') = replace(upper(:postal_code), ' ', ''))
ORDER BY total_external_funding DESC, id LIMIT :limit"""

_KEYS = ", ".join(PAYMENT_KEYS)
_ALL_KEYS = " AND ".join(f"{key} IS NOT NULL" for key in PAYMENT_KEYS)
# Of equal keys and equal absolute amount the smallest id of each sign, the negative one only without a twin.
PAYMENTS = f"""
WITH sides AS (
    SELECT {_KEYS}, abs(amount) AS size, min(id) FILTER (WHERE amount IS NULL OR amount >= 0) AS plus, min(id) FILTER (WHERE amount < 0) AS minus
    FROM ab.ab_grants WHERE recipient IS NOT NULL GROUP BY ALL),
twins AS (SELECT *, plus IS NOT NULL AND minus IS NOT NULL AND (:null_safe OR ({_ALL_KEYS})) AS paired FROM sides)
SELECT plus AS id, {_KEYS}, size AS amount, paired AS has_reversal_pair FROM twins WHERE plus IS NOT NULL
UNION ALL SELECT minus, {_KEYS}, -size, false FROM twins WHERE minus IS NOT NULL AND NOT paired"""


def findings_feed(spark: SparkSession, limit: int = 50, floor: int = 10, rules: ScoreRules = ScoreRules()) -> DataFrame:
    return spark.sql(_feed(rules), args={"limit": limit, "floor": floor})


def postal_lookup(spark: SparkSession, postal_code: str, limit: int = 50) -> DataFrame:
    return spark.sql(POSTAL, args={"postal_code": postal_code, "limit": limit})


def clean_payments(spark: SparkSession, null_safe: bool = False) -> DataFrame:
    return spark.sql(PAYMENTS, args={"null_safe": null_safe})
