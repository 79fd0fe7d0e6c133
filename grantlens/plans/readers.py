"""Queries over sources and display functions: qualified tables, bulk documents, dates, links, number roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.provenance import evidence_hash, token_seal
from ..operators import briefs, dossier
from ..session import shared_path
from ..sources import documents
from ..sources.tables import load_and_gate, register_schemas, register_views
from . import inputs as i
from .spending import BASE


def qualified_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables read by name and addressed as views."""
    register_views(spark, d, ("orders", "customer"))
    o, c = spark.table("orders"), spark.table("customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def schema_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables named as their owner names them: one by schema and table, one through the search path. The session's current schema stays."""
    where = shared_path(spark, "tables")
    for name in ("orders", "customer"):
        i.table(spark, d, name).write.parquet(f"{where}/lens_fed/{name}.parquet")
    i.table(spark, d, "nation").write.parquet(f"{where}/lens_cra/nation.parquet")
    register_schemas(spark, where, ("lens_fed.orders", "lens_fed.customer", "lens_cra.nation"), search_path=("lens_fed", "lens_cra"))
    return spark.sql("""SELECT n_name, count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total
        FROM lens_fed.orders JOIN customer ON o_custkey = c_custkey JOIN lens_cra.nation ON c_nationkey = n_nationkey GROUP BY n_name""")


# Tables loaded and the rows a complete load has at least; one of them falls short.
LOADED = {"orders": 1000, "lineitem": 1000, "customer": 100, "part": 100, "supplier": 10, "region": 6}


def load_gate(spark: SparkSession, d: str) -> DataFrame:
    """Six tables loaded, each gated by the rows that its own write counted."""
    return load_and_gate({name: i.table(spark, d, name) for name in LOADED}, shared_path(spark, "loaded"), LOADED)[1]


def findings_scan(spark: SparkSession, d: str) -> DataFrame:
    """Finding cards written one per line and read in bulk, their evidence split again; highest indicator count first."""
    path = shared_path(spark, "findings")
    cards = i.findings(spark, d).drop("custkey")
    token = F.col("proofToken")
    raw = F.transform(token["evidence"], lambda e: F.struct(
        e["source"].alias("source"), e["row_id"].alias("rowId"), e["field"].alias("field"), e["value_num"].alias("value"), e["as_of"].alias("asOf")))
    cards.withColumn("proofToken", token.withField("evidence", raw)).write.json(path)
    back = briefs.feed(documents.read_findings(spark, path, one_per_line=True), "", "indicators")
    first = F.col("proofToken")["evidence"][0]
    return back.select(F.col("proofToken")["proofId"].alias("proof_id"), "indicatorCount", first["row_id"].alias("row_id"), first["value_num"].cast("double").alias("value_num"))


# Eight decimals, an exponent, more digits than a decimal holds, or a text, as a document writes them.
WRITTEN = ("CASE WHEN o_orderpriority = '1-URGENT' THEN concat('\"', o_orderstatus, ' 1.50\"') WHEN o_orderpriority = '5-LOW' THEN concat(cast(o_orderkey % 9 + 1 AS string), 'e23')"
           " WHEN o_orderpriority = '2-HIGH' THEN concat(cast(o_orderkey + 1 AS string), '000000000000000000000000000000')"
           " ELSE concat(cast(o_orderkey + 1 AS string), '.', lpad(cast(o_custkey * 7919 % 100000000 AS string), 8, '0')) END")
HEAD = "concat('{\"proofId\":\"ppm-', cast(o_orderkey AS string), '\"')"


def exact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Finding cards whose evidence numbers no double or short decimal holds, read back, hashed and sealed."""
    path = shared_path(spark, "findings")
    line = f"""concat('{{"proofToken":', {HEAD}, ',"evidence":[{{"source":"orders","rowId":', cast(o_orderkey AS string), ',"value":', {WRITTEN},
        '}}],"tiers":{{"audit":{{"tier":4,"tokenHash":"sha256:x"}}}}}},"indicatorCount":1}}')"""
    i.table(spark, d, "orders").selectExpr(f"{line} AS value").write.text(path)
    token = F.col("proofToken")
    back = documents.read_findings(spark, path, one_per_line=True)
    first = token["evidence"][0]
    return back.select(
        token["proofId"].alias("proof_id"), first["value_raw"].alias("value_raw"), first["value_str"].alias("value_str"),
        first["value_num"].cast("string").alias("value_num"), evidence_hash(token["evidence"]).alias("evidence_hash"), token_seal("proofToken").alias("seal"))


EXACT_SQL = f"""WITH w AS (SELECT {HEAD} AS head, concat('ppm-', o_orderkey) AS proof_id, o_orderkey, {WRITTEN.replace('AS string', 'AS varchar')} AS written FROM orders),
    n AS (SELECT *, CASE WHEN written LIKE '"%' THEN trim(written, '"') END AS value_str, CASE WHEN written NOT LIKE '"%' THEN written END AS value_raw,
        CASE WHEN written LIKE '%e23' THEN concat(left(written, 1), repeat('0', 23), '.', repeat('0', 10)) WHEN written LIKE '%.%' AND written NOT LIKE '"%' THEN concat(written, '00') END AS value_num FROM w),
    e AS (SELECT *, concat('[{{"source":"orders","row_id":"', o_orderkey, '","field":null,"value_str":', coalesce('"' || value_str || '"', 'null'),
        ',"value_num":', coalesce(value_num, 'null'), ',"value_raw":', coalesce('"' || value_raw || '"', 'null'), ',"as_of":null}}]') AS ev FROM n)
    SELECT proof_id, value_raw, value_str, value_num, sha256(ev) AS evidence_hash, concat('sha256:', sha256(concat(head,
        ',"version":null,"issuedAt":null,"issuedBy":null,"finding":null,"evidence":', ev, ',"tiers":{{"input":null,"contextual":null,"output":null,"audit":{{"passed":null,"tier":4,',
        '"tokenHash":"","previousTokenHash":null,"humanReviewed":null,"humanReviewer":null,"operatorAgent":null,"logRef":null}}}},"disclaimers":null,"rerunUrl":null}}'))) AS seal FROM e"""


def register_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "register")
    i.register(spark, d).write.json(path)
    return documents.read_register(spark, path, one_per_line=True).select("aiaId", "department", "impactLevel", "mitigationScore")


def date_display(spark: SparkSession, d: str) -> DataFrame:
    e = i.table(spark, d, "events")
    return e.select(
        "event_id", scalar.iso_millis("ts").alias("iso"), scalar.utc_text("ts").alias("utc"),
        scalar.date_prefix(scalar.iso_millis("ts"), 4).alias("year"), scalar.date_prefix(scalar.iso_millis("ts")).alias("day"))


def link_coding(spark: SparkSession, d: str) -> DataFrame:
    """Whole page texts as URI components and back."""
    p = i.table(spark, d, "pages").withColumn("coded", scalar.uri_encode("html"))
    return p.select("page_id", F.md5("coded").alias("coded"), (scalar.uri_decode("coded") == F.col("html")).alias("same"))


# Every third order names a program account of the number instead of the number.
ACCOUNT = "CASE WHEN _id % 3 = 0 THEN concat(recipient_business_number, 'RR0001') ELSE recipient_business_number END"


def number_root_join(spark: SparkSession, d: str) -> DataFrame:
    """Grants matched by the root of the recipient's number."""
    grants = i.grants(spark, d).withColumn("recipient_business_number", F.expr(ACCOUNT))
    matched = dossier.match_grants(i.entities(spark, d), grants, by_root=True)
    return matched.select("entity_id", "_id", scalar.bn_root("recipient_business_number").alias("root"))


QUERIES = {f.__name__: f for f in (qualified_tables, schema_tables, load_gate, findings_scan, exact_evidence, register_scan, date_display, link_coding, number_root_join)}

ORACLES = {
    "qualified_tables": """SELECT c_mktsegment, count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "schema_tables": """SELECT n_name, count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "load_gate": " UNION ALL ".join(f"SELECT '{name}' AS label, count(*) AS n, cast({least} AS bigint) AS expected_at_least, count(*) >= {least} AS passed FROM {name}"
                                    for name, least in LOADED.items()),
    "findings_scan": f"""SELECT proof_id, cast(length(summary) AS int) AS "indicatorCount", cast(custkey AS varchar) AS row_id, cast(headline_value AS double) AS value_num
        FROM ({i.TOKENS_SQL}) WHERE updated_nation <> 14 AND proof_id IS NOT NULL""",
    "exact_evidence": EXACT_SQL,
    "register_scan": f"""SELECT "aiaId", department, "impactLevel", "mitigationScore" FROM ({i.REGISTER_SQL})""",
    "date_display": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS utc,
        strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m-%d') AS day FROM events""",
    "link_coding": """SELECT page_id, md5(replace(replace(replace(replace(replace(url_encode(html), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')) AS coded,
        true AS same FROM pages""",
    "number_root_join": BASE + f""", g AS (SELECT * REPLACE ({ACCOUNT} AS recipient_business_number) FROM grants)
        SELECT e.id AS entity_id, g._id, nullif(regexp_extract(g.recipient_business_number, '^([0-9]{{9}})', 1), '') AS root FROM g JOIN entities e
        ON (e.bn_root IS NOT NULL AND left(g.recipient_business_number, 9) = e.bn_root)
        OR (e.bn_root IS NULL AND lower(g.recipient_legal_name) = lower(e.canonical_name))""",
}
