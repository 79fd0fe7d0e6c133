"""Queries over chains of tokens, with their checks: a customer's orders re-score one another, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import chains
from . import inputs as i

# Where a customer's first order points: nowhere, to the customer's last order (a cycle), or to a hash nobody has.
FIRST = ("CASE WHEN o_custkey % 17 = 0 THEN concat('sha256:', last_key) WHEN o_custkey % 19 = 0 THEN concat('lost:', o_orderkey)"
         " WHEN o_custkey % 23 = 0 THEN '' END")


def _chained(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders").select("o_custkey", "o_orderkey").distinct()
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = o.withColumn("before", F.lag("o_orderkey").over(w)).withColumn("last_key", F.max("o_orderkey").over(whole))
    previous = F.when(F.col("before").isNotNull(), F.concat(F.lit("sha256:"), F.col("before").cast("string"))).otherwise(F.expr(FIRST))
    audit = F.struct(F.concat(F.lit("sha256:"), F.col("o_orderkey").cast("string")).alias("tokenHash"), previous.alias("previousTokenHash"))
    token = F.struct(F.concat(F.lit("ppm-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("proofId"), F.struct(audit.alias("audit")).alias("tiers"))
    return o.select(token.alias("proofToken"))


def chain_generations(spark: SparkSession, d: str) -> DataFrame:
    return chains.chain_generations(_chained(spark, d))


def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    return chains.chain_summary(chains.chain_generations(_chained(spark, d)))


WALK = f"""WITH RECURSIVE o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
        max(o_orderkey) OVER (PARTITION BY o_custkey) AS last_key FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)),
    t AS (SELECT concat('ppm-', lpad(cast(o_orderkey AS varchar), 12, '0')) AS proof_id, concat('sha256:', o_orderkey) AS h,
        nullif(CASE WHEN before IS NOT NULL THEN concat('sha256:', before) ELSE {FIRST} END, '') AS previous_hash FROM o),
    parent AS (SELECT h, min(proof_id) AS parent_id FROM t GROUP BY h),
    walk AS (SELECT proof_id, h, proof_id AS root_id, cast(0 AS bigint) AS depth FROM t WHERE previous_hash IS NULL OR previous_hash NOT IN (SELECT h FROM t)
        UNION ALL SELECT t.proof_id, t.h, w.root_id, w.depth + 1 FROM walk w JOIN parent p ON p.parent_id = w.proof_id AND p.h = w.h JOIN t ON t.previous_hash = w.h),
    told AS (SELECT t.proof_id, t.previous_hash, root_id, depth,
        CASE WHEN t.previous_hash IS NOT NULL THEN t.previous_hash IN (SELECT h FROM t) END AS parent_found, root_id IS NULL AS cyclic
        FROM t LEFT JOIN walk w ON t.proof_id = w.proof_id AND t.h = w.h)"""

QUERIES = {f.__name__: f for f in (chain_generations, chain_summary)}
ORACLES = {
    "chain_generations": WALK + " SELECT * FROM told",
    "chain_summary": WALK + """ SELECT root_id, count(*) AS tokens, max(depth) + 1 AS generations,
        bool_or(depth = 0 AND NOT coalesce(parent_found, true)) AS dangling FROM told WHERE NOT cyclic GROUP BY root_id""",
}
