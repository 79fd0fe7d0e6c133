"""Queries over spending-shaped tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import comparables, dossier, guards, parameterised, scoring
from ..session import shared_path
from ..sources.tables import register_schemas, row_count_gate
from . import inputs as i

CURRENT = """SELECT * FROM (
    SELECT *, row_number() OVER (
        PARTITION BY ref_number, coalesce(recipient_business_number, recipient_legal_name, cast(_id AS varchar))
        ORDER BY cast(nullif(amendment_number, '') AS int) DESC NULLS LAST, _id DESC) AS rn FROM grants) WHERE rn = 1"""

BASE = f"""WITH grants AS ({i.GRANTS_SQL}), entities AS ({i.ENTITIES_SQL}), loops AS ({i.LOOPS_SQL}),
    violations AS ({i.VIOLATIONS_SQL}), payments AS ({i.PAYMENTS_SQL}), cur AS ({CURRENT}),
    totals AS (SELECT coalesce(recipient_business_number, recipient_legal_name) AS recipient_key,
        sum(agreement_value) AS total_commitment, count(*) AS agreement_count
        FROM cur WHERE agreement_value IS NOT NULL GROUP BY 1)"""

SCORED = """scored AS (
    SELECT *, CASE WHEN composite_score >= 22 THEN 'CRITICAL' WHEN composite_score >= 14 THEN 'HIGH'
                   WHEN composite_score >= 7 THEN 'MEDIUM' ELSE 'LOW' END AS score_label
    FROM (SELECT e.id AS entity_id, e.canonical_name, e.bn_root,
        cast(coalesce(t.total_commitment, 0) AS double) AS fed_total_commitment,
        coalesce(t.agreement_count, 0) AS fed_agreement_count,
        coalesce(l.score, 0) AS max_loop_score, coalesce(l.total_loops, 0) AS loop_count,
        coalesce(v.n, 0) AS arithmetic_violations,
        cast(least(30,
          (CASE WHEN t.total_commitment > 100000000 THEN 6 WHEN t.total_commitment > 10000000 THEN 4
                WHEN t.total_commitment > 1000000 THEN 2 ELSE 0 END)
          + (CASE WHEN t.agreement_count > 50 THEN 4 WHEN t.agreement_count > 10 THEN 2 ELSE 0 END)
          + coalesce(l.score // 4, 0)
          + (CASE WHEN l.total_loops > 5 THEN 3 ELSE 0 END)
          + (CASE WHEN v.n > 0 THEN 3 ELSE 0 END)
          + (CASE WHEN e.sources_text LIKE '%fed%' AND e.sources_text LIKE '%cra%' THEN 2 ELSE 0 END)) AS int) AS composite_score
      FROM entities e
      LEFT JOIN totals t ON coalesce(e.bn_root, e.canonical_name) = t.recipient_key
      LEFT JOIN loops l ON l.bn = e.bn_root
      LEFT JOIN (SELECT bn, count(*) AS n FROM violations GROUP BY bn) v ON v.bn = e.bn_root))"""

FEED_COLUMNS = (
    "entity_id, canonical_name, bn_root, fed_total_commitment, fed_agreement_count, max_loop_score, loop_count,"
    " arithmetic_violations, composite_score, score_label"
)


def money(*names: str):
    def cast(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.col(n).cast("double") for n in names})

    return cast


def current_version_orders(spark: SparkSession, d: str) -> DataFrame:
    out = guards.current_version(i.grants(spark, d))
    return out.select("_id", "ref_number", "recipient_business_number", "amendment_number", F.col("agreement_value").cast("double"))


def current_version_lineitem(spark: SparkSession, d: str) -> DataFrame:
    df = i.table(spark, d, "lineitem")
    version = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_linenumber").cast("string"))
    ties = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    order = [scalar.blank_to_int(version).desc_nulls_last(), *[F.col(c).desc() for c in ties], F.col("l_linestatus").desc()]
    out = guards.current_version(df, keys=["l_orderkey"], order=order)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


def recipient_totals(spark: SparkSession, d: str) -> DataFrame:
    out = guards.recipient_totals(guards.current_version(i.grants(spark, d)))
    return out.transform(money("total_commitment"))


def _feed(spark: SparkSession, d: str, **kw) -> DataFrame:
    return scoring.findings_feed(i.entities(spark, d), i.grants(spark, d), i.loops(spark, d), i.violations(spark, d), **kw)


def findings_feed(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d).drop("dataset_sources").transform(money("fed_total_commitment"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    totals = guards.recipient_totals(guards.current_version(i.grants(spark, d)))
    return scoring.score_entities(i.entities(spark, d), totals, i.loops(spark, d), i.violations(spark, d))


def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).drop("dataset_sources").transform(money("fed_total_commitment"))


def score_label_dist(spark: SparkSession, d: str) -> DataFrame:
    return scoring.label_distribution(_scored(spark, d))


def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    kept = guards.dedupe_exact(i.payments(spark, d), [*guards.PAYMENT_KEYS, "amount"], [F.col("id")])
    return _payment_columns(kept)


def _payment_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "id", "ministry", "business_unit_name", "recipient", F.col("amount").cast("double"),
        F.col("payment_date").cast("string").alias("payment_date"), *extra,
    )


PAYMENT_SQL = "id, ministry, business_unit_name, recipient, cast(amount AS double) AS amount, cast(payment_date AS varchar) AS payment_date"
DEDUPED = """SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY ministry, business_unit_name, recipient, program, amount, payment_date ORDER BY id) AS rn
    FROM payments {where}) WHERE rn = 1"""
PAIRED = f"""deduped AS ({DEDUPED.format(where='WHERE recipient IS NOT NULL')}),
    paired AS (SELECT a.*, EXISTS (SELECT 1 FROM deduped b WHERE b.ministry = a.ministry
        AND b.business_unit_name = a.business_unit_name AND b.recipient = a.recipient AND b.program = a.program
        AND b.amount = -a.amount AND b.payment_date = a.payment_date AND b.id <> a.id) AS has_reversal_pair FROM deduped a)"""


def reversal_flags(spark: SparkSession, d: str) -> DataFrame:
    kept = guards.exclude_rollups(i.payments(spark, d))
    kept = guards.dedupe_exact(kept, [*guards.PAYMENT_KEYS, "amount"], [F.col("id")])
    return _payment_columns(guards.flag_reversals(kept), "has_reversal_pair")


def clean_payments(spark: SparkSession, d: str) -> DataFrame:
    return _payment_columns(guards.clean_payments(i.payments(spark, d)), "has_reversal_pair")


def omitted_rollup(spark: SparkSession, d: str) -> DataFrame:
    return guards.omitted_rollup(i.payments(spark, d), by=["ministry"]).transform(money("omitted_amount"))


def amendment_profile(spark: SparkSession, d: str) -> DataFrame:
    out = guards.amendment_profile(i.grants(spark, d), keys=["ref_number"])
    return out.transform(money("first_value", "max_value", "growth"))


def description_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = guards.description_gaps(i.grants(spark, d), min_value=250_000)
    return out.select("_id", "ref_number", "description_en", F.col("agreement_value").cast("double"))


def comparable_grants(spark: SparkSession, d: str) -> DataFrame:
    return comparables.comparable_grants(i.grants(spark, d)).transform(money("amount"))


def comparable_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every part against all others: brand as program, type as department, size as year."""
    p = i.table(spark, d, "part")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("ref"), F.col("p_brand").alias("program"),
        F.col("p_type").alias("department"), (F.col("p_retailprice") * F.col("p_size")).cast("decimal(18,2)").alias("value"),
        (F.lit(1970) + F.col("p_size")).alias("year"), (F.length("p_name") > 8).alias("described"),
    )
    out = comparables.match_comparables(rows, comparables.pick_sources(rows), k=8)
    return out.select("source_ref", "ref", F.col("value").cast("double"), "similarity_tier", "position")


PARTS_SQL = """WITH p AS (SELECT p_partkey, p_brand, p_type, cast(p_retailprice * p_size AS decimal(18,2)) AS v, p_size,
        length(p_name) > 8 AS described FROM part),
    pairs AS (SELECT s.p_partkey AS s_id, c.p_partkey AS c_id, c.v,
        CASE WHEN c.p_brand = s.p_brand AND c.v BETWEEN s.v * 0.5 AND s.v * 1.5 THEN 1
             WHEN c.p_brand = s.p_brand AND abs(c.p_size - s.p_size) <= 5 THEN 2
             WHEN c.p_type = s.p_type THEN 3 END AS tier
        FROM p s JOIN p c ON c.p_partkey <> s.p_partkey AND c.described AND (c.p_brand = s.p_brand OR c.p_type = s.p_type)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY tier, v DESC, c_id) AS position FROM pairs WHERE tier IS NOT NULL)
    SELECT cast(s_id AS varchar) AS source_ref, cast(c_id AS varchar) AS ref, cast(v AS double) AS value,
           tier AS similarity_tier, cast(position AS int) AS position FROM ranked WHERE position <= 8"""

COMPARABLE_SQL = BASE + """,
    src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_number ORDER BY agreement_value DESC NULLS LAST, _id) AS pick
            FROM cur) WHERE pick = 1),
    pairs AS (SELECT s.ref_number AS source_ref, c.*,
        CASE WHEN c.prog_name_en = s.prog_name_en
                  AND c.agreement_value BETWEEN s.agreement_value * 0.5 AND s.agreement_value * 1.5 THEN 1
             WHEN c.prog_name_en = s.prog_name_en
                  AND abs(year(c.agreement_start_date) - year(s.agreement_start_date)) <= 5 THEN 2
             WHEN c.owner_org_title = s.owner_org_title THEN 3 END AS similarity_tier
        FROM src s JOIN cur c ON c.ref_number <> s.ref_number
        WHERE c.description_en IS NOT NULL AND length(c.description_en) > 80),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source_ref
            ORDER BY similarity_tier, agreement_value DESC NULLS LAST, _id) AS position
        FROM pairs WHERE similarity_tier IS NOT NULL),
    best AS (SELECT source_ref, ref_number AS grant_id, _id AS id, description_en AS description,
        cast(agreement_value AS double) AS amount, owner_org_title AS department_code,
        cast(year(agreement_start_date) + 1 AS int) AS fiscal_year, similarity_tier,
        cast(position AS int) AS position FROM ranked WHERE position <= 12)"""


def comparable_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return comparables.tier_counts(comparables.comparable_grants(i.grants(spark, d)))


def or_key_join(spark: SparkSession, d: str) -> DataFrame:
    matched = dossier.match_grants(i.entities(spark, d), i.grants(spark, d))
    return matched.select("entity_id", "_id", "ref_number")


OR_JOIN = """SELECT e.id AS entity_id, g.* FROM grants g JOIN entities e
    ON (e.bn_root IS NOT NULL AND g.recipient_business_number = e.bn_root)
    OR (e.bn_root IS NULL AND lower(g.recipient_legal_name) = lower(e.canonical_name))"""
ENTITY_CURRENT = f"""matched AS ({OR_JOIN}),
    ac AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY entity_id, ref_number, coalesce(recipient_business_number, recipient_legal_name, cast(_id AS varchar))
        ORDER BY cast(nullif(amendment_number, '') AS int) DESC NULLS LAST, _id DESC) AS rn FROM matched) WHERE rn = 1)"""


def _dossiers(spark: SparkSession, d: str, **kw) -> dossier.Dossiers:
    return dossier.entity_dossier(i.entities(spark, d), i.grants(spark, d), i.violations(spark, d), i.loops(spark, d), **kw)


def entity_dossier(spark: SparkSession, d: str) -> DataFrame:
    """The nested dossiers, flattened to compare."""
    s = F.col("fed_summary")
    return dossier.nest_dossiers(_dossiers(spark, d)).select(
        "entity_id",
        F.col("entity.canonical_name").alias("canonical_name"),
        s["total_current_commitment"].cast("double").alias("total_current_commitment"),
        s["agreement_count"].cast("double").alias("agreement_count"),
        s["earliest_start"].cast("string").alias("earliest_start"),
        s["latest_end"].cast("string").alias("latest_end"),
        F.array_join(s["departments"], ",").alias("departments"),
        F.array_join(s["programs"], ",").alias("programs"),
        F.array_join(s["countries"], ",").alias("countries"),
        F.array_join(s["provinces"], ",").alias("provinces"),
        F.array_join(F.transform("agreements", lambda a: a["_id"].cast("string")), ",").alias("agreement_ids"),
        F.col("violations.arithmetic_violations").cast("double").alias("arithmetic_violations"),
        F.size("loops").alias("loop_rows"),
        F.get("loops", F.lit(0))["score"].cast("double").alias("top_loop_score"),
    )


PAGE_ROWS = 4


def dossier_pages(spark: SparkSession, d: str) -> DataFrame:
    """Heads against their pages: several pages per entity, every agreement on one of them; up to five of many loops."""
    purchases = i.table(spark, d, "events").filter("event_type = 'purchase'")
    daily = purchases.selectExpr(f"{i.USER9} AS bn", "cast(event_id AS string) AS legal_name", "cast(floor(value) AS int) AS score", "user_id % 7 AS total_loops",
                                 "cast(value AS decimal(18,2)) AS max_bottleneck", "cast(value AS decimal(18,2)) AS total_circular_amt")
    heads, pages = dossier.entity_dossier(i.entities(spark, d), i.grants(spark, d), i.violations(spark, d), daily, keep_empty=True, page_rows=PAGE_ROWS)
    ids = F.transform("agreements", lambda a: a["_id"])
    held = pages.groupBy("entity_id").agg(F.sort_array(F.flatten(F.collect_list(ids))).alias("ids"))
    loop_ids = F.array_join(F.transform("loops", lambda x: x["legal_name"]), ",")
    return heads.join(held, "entity_id", "left").select(
        "entity_id", "pages", F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("agreement_ids"), loop_ids.alias("loop_ids"))


PAGES_SQL = BASE + f""", {ENTITY_CURRENT},
    a AS (SELECT entity_id, count(*) AS n, string_agg(cast(_id AS varchar), ',' ORDER BY _id) AS ids FROM ac GROUP BY 1),
    lp AS (SELECT {i.USER9} AS bn, cast(event_id AS string) AS id, cast(floor(value) AS int) AS score, user_id % 7 AS total FROM events WHERE event_type = 'purchase'),
    top AS (SELECT e.id AS entity_id, lp.id, row_number() OVER (PARTITION BY e.id ORDER BY lp.score DESC, lp.total DESC, lp.id) AS k
        FROM entities e JOIN lp ON lp.bn = e.bn_root),
    five AS (SELECT entity_id, string_agg(id, ',' ORDER BY k) AS loop_ids FROM top WHERE k <= 5 GROUP BY 1)
    SELECT e.id AS entity_id, cast(coalesce(ceil(n / {PAGE_ROWS}), 0) AS int) AS pages, coalesce(ids, '') AS agreement_ids, coalesce(loop_ids, '') AS loop_ids
    FROM entities e LEFT JOIN a ON a.entity_id = e.id LEFT JOIN five f ON f.entity_id = e.id"""

def dossier_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in pages of two or so, taken apart again, beside their count in heads of fixed size."""
    heads = _dossiers(spark, d, lists=False).heads
    agreements = dossier.entity_agreements(i.entities(spark, d), i.grants(spark, d))
    counted = heads.select("entity_id", F.inline(F.array(*[F.struct(F.lit(n).alias("list"), F.col("fed_summary")[n].alias("counted")) for n in dossier.LISTS])))
    values = dossier.value_pages(agreements, page_values=2).select("entity_id", "list", F.explode("values").alias("value"))
    return values.join(counted, ["entity_id", "list"])


VALUES_SQL = BASE + f""", {ENTITY_CURRENT},
    v AS (SELECT DISTINCT entity_id, list, value FROM (""" + " UNION ALL ".join(
    f"SELECT entity_id, '{name}' AS list, {column} AS value FROM ac WHERE agreement_value IS NOT NULL AND {column} IS NOT NULL" for name, column in dossier.LISTS.items()
) + """)) SELECT *, count(*) OVER (PARTITION BY entity_id, list) AS counted FROM v"""

DOSSIER_SQL = BASE + f""", {ENTITY_CURRENT},
    s AS (SELECT entity_id, sum(agreement_value) AS total, count(*) AS n, min(agreement_start_date) AS a, max(agreement_end_date) AS b,
        list_sort(list(DISTINCT owner_org_title)) AS dep, list_sort(list(DISTINCT prog_name_en)) AS prog,
        list_sort(list(DISTINCT recipient_country)) AS ctry,
        list_sort(list(DISTINCT recipient_province) FILTER (recipient_province IS NOT NULL)) AS prov
        FROM ac WHERE agreement_value IS NOT NULL GROUP BY 1),
    a AS (SELECT entity_id, string_agg(cast(_id AS varchar), ',' ORDER BY _id) AS ids FROM ac GROUP BY 1)
    SELECT e.id AS entity_id, e.canonical_name, cast(s.total AS double) AS total_current_commitment, cast(s.n AS double) AS agreement_count,
        cast(s.a AS varchar) AS earliest_start, cast(s.b AS varchar) AS latest_end, array_to_string(s.dep, ',') AS departments,
        array_to_string(s.prog, ',') AS programs, array_to_string(s.ctry, ',') AS countries,
        coalesce(array_to_string(s.prov, ','), CASE WHEN s.n IS NOT NULL THEN '' END) AS provinces,
        a.ids AS agreement_ids, cast(v.n AS double) AS arithmetic_violations,
        CASE WHEN l.bn IS NULL THEN 0 ELSE 1 END AS loop_rows, cast(l.score AS double) AS top_loop_score
    FROM a JOIN entities e ON e.id = a.entity_id LEFT JOIN s ON s.entity_id = a.entity_id
    LEFT JOIN (SELECT bn, count(*) AS n FROM violations GROUP BY 1) v ON v.bn = e.bn_root
    LEFT JOIN loops l ON l.bn = e.bn_root"""

# A seed per customer: whole names in capitals, the end of a name, one with wildcards, a number of another.
SEEDS = {
    "name": "CASE WHEN c_nationkey = 2 AND c_acctbal < -900 THEN concat('#_', substring(c_name, 11, 6), '%', substring(c_name, 18, 1)) WHEN c_nationkey % 4 = 0 THEN upper(c_name)"
    " WHEN c_nationkey % 4 = 1 THEN substring(c_name, 13, 6) WHEN c_nationkey = 7 THEN concat('Nobody ', c_name) ELSE c_name END",
    "bn": "CASE WHEN c_mktsegment = 'BUILDING' THEN lpad(cast(c_custkey + 1 AS string), 9, '0') END",
}


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "customer").selectExpr(*[f"{e} AS {n}" for n, e in SEEDS.items()])


def _seeded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return dossier.seed_dossiers(_seeds(spark, d), i.entities(spark, d), i.grants(spark, d), i.violations(spark, d), i.loops(spark, d))


def seed_dossiers(spark: SparkSession, d: str) -> DataFrame:
    """All four parts in one long table."""
    parts = _seeded(spark, d)
    shown = {"golden": "id", "loops": "bn", "agreements": "cast(_id AS string)", "violations": "bn"}
    value = {"golden": "NULL", "loops": "score", "agreements": "agreement_value", "violations": "arithmetic_violations"}
    out = None
    for name, part in parts.items():
        rows = part.selectExpr("seed", f"'{name}' AS part", "cast(position AS bigint) AS position", f"{shown[name]} AS key", f"cast({value[name]} AS double) AS value")
        out = rows if out is None else out.unionByName(rows)
    return out


SEEDS_SQL = BASE + f""", seeds AS (SELECT DISTINCT {SEEDS['name']} AS seed, {SEEDS['bn']} AS sbn FROM customer),
    golden AS (SELECT seed, id AS key, NULL AS value, row_number() OVER (PARTITION BY seed ORDER BY id) AS position
        FROM entities e JOIN seeds ON e.canonical_name ILIKE concat('%', seed, '%') OR (sbn IS NOT NULL AND e.bn_root = sbn)),
    named AS (SELECT seed, bn_root AS bn FROM entities e JOIN seeds ON e.canonical_name ILIKE concat('%', seed, '%') WHERE bn_root IS NOT NULL),
    lp AS (SELECT seed, l.bn AS key, l.score AS value, row_number() OVER (PARTITION BY seed
        ORDER BY l.score DESC NULLS LAST, l.total_loops DESC NULLS LAST, l.bn) AS position FROM loops l JOIN named USING (bn)),
    ag AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY value DESC NULLS LAST, id) AS position FROM (
        SELECT seed, _id AS id, cast(_id AS varchar) AS key, agreement_value AS value, row_number() OVER (
          PARTITION BY seed, ref_number, coalesce(recipient_business_number, recipient_legal_name, cast(_id AS varchar))
          ORDER BY cast(nullif(amendment_number, '') AS int) DESC NULLS LAST, _id DESC) AS rn
        FROM grants JOIN seeds ON recipient_legal_name ILIKE concat('%', seed, '%') OR (sbn IS NOT NULL AND recipient_business_number = sbn))
        WHERE rn = 1),
    vi AS (SELECT seed, v.bn AS key, count(*) AS value, row_number() OVER (PARTITION BY seed ORDER BY v.bn) AS position
        FROM violations v JOIN named USING (bn) GROUP BY seed, v.bn)
    SELECT seed, 'golden' AS part, position, key, cast(value AS double) AS value FROM golden WHERE position <= 5
    UNION ALL SELECT seed, 'loops', position, key, cast(value AS double) FROM lp WHERE position <= 5
    UNION ALL SELECT seed, 'agreements', position, key, cast(value AS double) FROM ag WHERE position <= 100
    UNION ALL SELECT seed, 'violations', position, key, cast(value AS double) FROM vi WHERE position <= 10"""

FUNDED = """funded AS (SELECT id, canonical_name, bn_root,
        replace(upper(unnest(list_distinct(string_split(postal_text, ',')))), ' ', '') AS postal_code,
        coalesce(try_cast(json_extract_string(fed_profile, '$.total_grants') AS decimal(38,6)), 0)
        + coalesce(try_cast(json_extract_string(ab_profile, '$.total_grants') AS decimal(38,6)), 0)
        + coalesce(try_cast(json_extract_string(ab_profile, '$.total_contracts') AS decimal(38,6)), 0)
        + coalesce(try_cast(json_extract_string(ab_profile, '$.total_sole_source') AS decimal(38,6)), 0) AS funding FROM entities)"""


def postal_rollup(spark: SparkSession, d: str) -> DataFrame:
    return dossier.postal_rollup(i.entities(spark, d)).transform(money("total_external_funding"))


def postal_totals(spark: SparkSession, d: str) -> DataFrame:
    return dossier.postal_totals(i.entities(spark, d)).transform(money("total_external_funding"))


def postal_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dossier.postal_lookup(i.entities(spark, d), "h3 A0b1").drop("dataset_sources").transform(money("total_external_funding"))


def _catalogued(spark: SparkSession, d: str) -> None:
    """The inputs as tables of the schemas that the SQL names."""
    where = shared_path(spark, "tables")
    tables = {"general.entity_golden_records": i.entities, "fed.grants_contributions": i.grants, "cra.t3010_impossibilities": i.violations,
              "cra.loop_universe": i.loops, "ab.ab_grants": i.payments}
    for name, made in tables.items():
        made(spark, d).write.parquet(f"{where}/{name.replace('.', '/')}.parquet")
    register_schemas(spark, where, tables)


def findings_feed_sql(spark: SparkSession, d: str) -> DataFrame:
    """The feed by SQL with named parameters."""
    _catalogued(spark, d)
    return parameterised.findings_feed(spark, limit=40, floor=9).drop("dataset_sources").transform(money("fed_total_commitment"))


def postal_lookup_sql(spark: SparkSession, d: str) -> DataFrame:
    _catalogued(spark, d)
    return parameterised.postal_lookup(spark, "h3 A0b1").drop("dataset_sources").transform(money("total_external_funding"))


def clean_payments_sql(spark: SparkSession, d: str) -> DataFrame:
    _catalogued(spark, d)
    return _payment_columns(parameterised.clean_payments(spark), "has_reversal_pair")


def fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders")
    return o.groupBy(
        scalar.fiscal_year("o_orderdate").alias("fiscal_year"), scalar.fiscal_year("o_orderdate", "as_coded").alias("coded_year")
    ).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
LEAST = {t: 100 for t in TABLES}


def table_gate(spark: SparkSession, d: str) -> DataFrame:
    return row_count_gate({t: i.table(spark, d, t) for t in TABLES}, LEAST)


def impact_gate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.briefs import impact_gate as gate

    return gate(i.register(spark, d))


def label_audit(spark: SparkSession, d: str) -> DataFrame:
    df = i.flat_tokens(spark, d).select("custkey", "score", F.col("label").alias("score_label"))
    return scoring.label_audit(df)


# Three weight vectors per nation: an even one, one that rises with the nation's key, one over the scale.
WEIGHTS = tuple(
    {"federal_concentration": f, "cra_loops": c, "t3010_violations": t, "dataset_cross_coverage": x}
    for f, c, t, x in (("5", "5", "5", "5"), ("n_nationkey % 11", "n_regionkey", "(n_nationkey * 7) % 11", "3"), ("10", "10", "0", "n_regionkey * 2"))
)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    nations, out = i.table(spark, d, "nation"), None
    for vector in WEIGHTS:
        part = nations.selectExpr("n_nationkey AS nation", *[f"cast({e} AS int) AS {n}" for n, e in vector.items()])
        out = part if out is None else out.unionByName(part)
    return out


def rescore_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    scored = i.flat_tokens(spark, d).select("custkey", "score", F.col("updated_nation").cast("int").alias("nation"))
    return scoring.rescore_sensitivity(scored, _weights(spark, d), ["nation"]).drop("weights", "nation")


def _label_case(c: str) -> str:
    return f"CASE WHEN {c} >= 22 THEN 'CRITICAL' WHEN {c} >= 14 THEN 'HIGH' WHEN {c} >= 7 THEN 'MEDIUM' ELSE 'LOW' END"


def _grid_sql() -> str:
    rows = []
    for vector in WEIGHTS:
        f, c, t, x = (f"cast({e} AS int)" for e in vector.values())
        rows.append(f"SELECT n_nationkey AS nation, concat('fc:', {f}, ',cl:', {c}, ',tv:', {t}, ',dc:', {x}) AS weights_code, {f} + {c} + {t} + {x} AS total FROM nation")
    return " UNION ALL ".join(rows)


RESCORE_SQL = f"""WITH t AS ({i.TOKENS_SQL}), grid AS ({_grid_sql()}),
    r AS (SELECT custkey, score, weights_code,
        cast(greatest(0, least(30, floor(score * (cast(total AS double) / 18) + 0.5))) AS int) AS new_score FROM t JOIN grid ON t.updated_nation = grid.nation)
    SELECT *, {_label_case('new_score')} AS new_label FROM r"""

QUERIES = {
    f.__name__: f
    for f in (
        current_version_orders, current_version_lineitem, recipient_totals, findings_feed, entity_scores, score_label_dist,
        exact_dedupe, reversal_flags, clean_payments, omitted_rollup, amendment_profile, description_gaps, comparable_grants,
        findings_feed_sql, postal_lookup_sql, clean_payments_sql, comparable_parts, comparable_tier_counts, or_key_join, entity_dossier, dossier_pages, dossier_values, seed_dossiers, postal_rollup, postal_totals,
        postal_lookup, fiscal_years, table_gate, impact_gate, label_audit, rescore_sensitivity,
    )
}

ORACLES = {
    "current_version_orders": BASE + " SELECT _id, ref_number, recipient_business_number, amendment_number, cast(agreement_value AS double) AS agreement_value FROM cur",
    "current_version_lineitem": """SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag
        FROM lineitem ORDER BY l_orderkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber END DESC NULLS LAST,
        l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
        l_shipdate DESC, l_linestatus DESC""",
    "recipient_totals": BASE + " SELECT recipient_key, cast(total_commitment AS double) AS total_commitment, agreement_count FROM totals",
    "findings_feed": BASE + f", {SCORED} SELECT {FEED_COLUMNS} FROM scored WHERE composite_score >= 10"
    " ORDER BY composite_score DESC, fed_total_commitment DESC NULLS LAST, entity_id LIMIT 50",
    "entity_scores": BASE + f", {SCORED} SELECT {FEED_COLUMNS} FROM scored",
    "score_label_dist": BASE + f", {SCORED} SELECT score_label, count(*) AS entities FROM scored GROUP BY 1",
    "exact_dedupe": BASE + f" SELECT {PAYMENT_SQL} FROM ({DEDUPED.format(where='')})",
    "reversal_flags": BASE + f", {PAIRED} SELECT {PAYMENT_SQL}, has_reversal_pair FROM paired",
    "clean_payments": BASE + f", {PAIRED} SELECT {PAYMENT_SQL}, has_reversal_pair FROM paired WHERE NOT has_reversal_pair OR amount > 0",
    "omitted_rollup": BASE + " SELECT ministry, count(*) AS omitted_rows, cast(sum(amount) AS double) AS omitted_amount FROM payments WHERE recipient IS NULL GROUP BY 1",
    "amendment_profile": BASE + """, v AS (SELECT *, cast(nullif(amendment_number, '') AS int) AS n FROM grants),
        f AS (SELECT ref_number, agreement_value AS first_value FROM (SELECT *, row_number() OVER (PARTITION BY ref_number
              ORDER BY coalesce(n, -1), _id) AS rn FROM v) WHERE rn = 1)
        SELECT ref_number, count(*) AS versions, count(*) FILTER (n > 0) AS amendment_count, cast(max(first_value) AS double) AS first_value,
               cast(max(agreement_value) AS double) AS max_value, cast(max(agreement_value) - max(first_value) AS double) AS growth
        FROM v JOIN f USING (ref_number) GROUP BY 1""",
    "description_gaps": BASE + """ SELECT _id, ref_number, description_en, cast(agreement_value AS double) AS agreement_value FROM cur
        WHERE agreement_value > 250000 AND (description_en IS NULL OR length(description_en) <= 80)""",
    "comparable_grants": COMPARABLE_SQL + " SELECT * FROM best",
    "comparable_parts": PARTS_SQL,
    "comparable_tier_counts": COMPARABLE_SQL + " SELECT source_ref, similarity_tier AS tier, count(*) AS grants FROM best GROUP BY 1, 2",
    "or_key_join": BASE + f" SELECT entity_id, _id, ref_number FROM ({OR_JOIN})",
    "entity_dossier": DOSSIER_SQL,
    "dossier_values": VALUES_SQL,
    "dossier_pages": PAGES_SQL,
    "seed_dossiers": SEEDS_SQL,
    "postal_rollup": BASE + f""", {FUNDED} SELECT * FROM (SELECT id, canonical_name, bn_root, cast(funding AS double) AS total_external_funding,
        postal_code, cast(row_number() OVER (PARTITION BY postal_code ORDER BY funding DESC, id) AS int) AS position FROM funded) WHERE position <= 50""",
    "postal_totals": BASE + f", {FUNDED} SELECT postal_code, count(*) AS entities, cast(sum(funding) AS double) AS total_external_funding FROM funded GROUP BY 1",
    "postal_lookup": BASE + f""", {FUNDED} SELECT id, canonical_name, bn_root, cast(funding AS double) AS total_external_funding
        FROM funded WHERE postal_code = 'H3A0B1' ORDER BY funding DESC, id LIMIT 50""",
    "postal_lookup_sql": BASE + f""", {FUNDED} SELECT id, canonical_name, bn_root, cast(funding AS double) AS total_external_funding
        FROM funded WHERE postal_code = 'H3A0B1' ORDER BY funding DESC, id LIMIT 50""",
    "findings_feed_sql": BASE + f", {SCORED} SELECT {FEED_COLUMNS} FROM scored WHERE composite_score >= 9"
    " ORDER BY composite_score DESC, fed_total_commitment DESC NULLS LAST, entity_id LIMIT 40",
    "clean_payments_sql": BASE + f", {PAIRED} SELECT {PAYMENT_SQL}, has_reversal_pair FROM paired WHERE NOT has_reversal_pair OR amount > 0",
    "fiscal_years": """SELECT cast(year(o_orderdate + INTERVAL 9 MONTH) AS int) AS fiscal_year, cast(year(o_orderdate) + 1 AS int) AS coded_year, count(*) AS orders,
        cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total FROM orders GROUP BY 1, 2""",
    "table_gate": " UNION ALL ".join(
        f"SELECT '{t}' AS label, count(*) AS n, cast({n} AS bigint) AS expected_at_least, count(*) >= {n} AS passed FROM {t}" for t, n in LEAST.items()
    ),
    "impact_gate": f"""WITH r AS ({i.REGISTER_SQL}) SELECT *, mitigationScore >= CASE impactLevel WHEN 1 THEN 0 WHEN 2 THEN 25
        WHEN 3 THEN 50 WHEN 4 THEN 75 END AS mitigation_passed FROM r""",
    "label_audit": f"""WITH t AS ({i.TOKENS_SQL}) SELECT custkey, score, label AS score_label, {_label_case('score')} AS derived_label
        FROM t WHERE label IS DISTINCT FROM {_label_case('score')}""",
    "rescore_sensitivity": RESCORE_SQL,
}
