"""Spending-shaped inputs derived from the given tables.

The expressions are plain SQL that Spark and DuckDB read alike, so a query and its check start
from the same rows. Gaps and defects come from the tables' own attributes, over every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. How finely it is read follows from spark.sql.files.maxPartitionBytes alone."""
    return table(spark, sf_dir, name)


def spread_texts(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has. A file of one row group is read by one task, however large it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _sql(columns: dict[str, str], source: str, tail: str = "") -> str:
    listed = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {listed} FROM {source} {tail}"


def _frame(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


CUST9 = "lpad(cast(o_custkey AS string), 9, '0')"
USER9 = "lpad(cast(user_id AS string), 9, '0')"
C9 = "lpad(cast(c_custkey AS string), 9, '0')"

GRANTS = {
    "_id": "o_orderkey",
    "ref_number": "concat('G', cast(cast(floor(o_custkey / 10) AS bigint) AS string), '-', cast(year(o_orderdate) AS string))",
    "amendment_number": "CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"
    " THEN NULL ELSE cast(month(o_orderdate) AS string) END",
    "recipient_business_number": f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {CUST9} END",
    "recipient_legal_name": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL"
    f" ELSE concat('Customer#', {CUST9}) END",
    "recipient_country": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'US' ELSE 'CA' END",
    "recipient_province": "CASE WHEN o_orderstatus = 'F' THEN 'AB' WHEN o_orderstatus = 'O' THEN 'ON' END",
    "agreement_value": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN NULL"
    " ELSE cast(o_totalprice AS decimal(18,2)) END",
    "agreement_start_date": "cast(o_orderdate AS date)",
    "agreement_end_date": "cast(o_orderdate AS date) + 365",
    "description_en": "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL"
    f" WHEN o_orderstatus = 'O' THEN concat('Contribution to ', {CUST9})"
    f" ELSE concat('Contribution agreement with recipient ', {CUST9}, ' towards the outcomes set out under ', o_orderpriority) END",
    "prog_name_en": "concat('Program ', o_orderpriority)",
    "owner_org_title": "concat('Department ', o_orderstatus)",
}
GRANTS_SQL = _sql(GRANTS, "orders")

ENTITIES = {
    "id": "concat('E', cast(c_custkey AS string))",
    "canonical_name": "c_name",
    "bn_root": f"CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE {C9} END",
    "sources_text": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'fed' WHEN c_mktsegment = 'MACHINERY' THEN 'ab,cra' ELSE 'cra,fed' END",
    "postal_text": "concat(lower(substring(c_mktsegment, 1, 1)), cast(c_nationkey AS string), 'a 0b1',"
    " CASE WHEN c_acctbal < 0 THEN concat(',X', cast(c_nationkey AS string), 'Y0Z0') ELSE '' END)",
    "fed_profile": "concat('{\"total_grants\": ', cast(cast(c_acctbal AS decimal(18,2)) AS string), '}')",
    "ab_profile": "CASE WHEN c_mktsegment = 'MACHINERY' THEN '{\"total_contracts\": \"n/a\"}'"
    " WHEN c_mktsegment = 'BUILDING' THEN '{\"total_grants\": 10.555, \"total_sole_source\": 12345678901234567}' END",
}
ENTITIES_SQL = _sql(ENTITIES, "customer")

LOOPS = {
    "bn": "bn",
    "legal_name": "concat('Customer#', bn)",
    "score": "cast(count(*) AS int)",
    "total_loops": "cast(floor(count(*) / 2) AS int)",
    "max_bottleneck": "max(amount)",
    "total_circular_amt": "cast(sum(amount) AS decimal(28,2))",
}
PURCHASES = {"bn": USER9, "amount": "cast(value AS decimal(18,2))"}
LOOPS_SQL = _sql(LOOPS, f"({_sql(PURCHASES, 'events', 'WHERE event_type = ' + chr(39) + 'purchase' + chr(39))})", "GROUP BY bn")
VIOLATIONS_SQL = _sql({"bn": USER9}, "events", "WHERE event_type = 'error'")

PAYMENTS = {
    "id": "event_id",
    "ministry": "event_type",
    "business_unit_name": "CASE WHEN event_type = 'view' AND user_id < 20 THEN NULL"
    " ELSE concat('Unit ', cast(cast(floor(user_id / 50) AS bigint) AS string)) END",
    "recipient": "CASE WHEN event_type = 'signup' AND hour(ts) < 6 THEN NULL ELSE concat('R', cast(user_id AS string)) END",
    "program": "'General'",
    "amount": "cast(CASE WHEN hour(ts) >= 18 THEN -10 ELSE 10 END * floor(value / 20) AS decimal(18,2))",
    "payment_date": "cast(ts AS date)",
}
PAYMENTS_SQL = _sql(PAYMENTS, "events")

TOKEN_TIME = "2024-01-01T00:00:00.000Z"
SCORE = "cast(floor((c_acctbal + 1000) / 400) AS int)"
TOKENS = {
    "custkey": "c_custkey",
    "proof_id": "CASE WHEN c_acctbal < -900 THEN NULL WHEN c_nationkey = 7 THEN concat('tok-', cast(c_custkey AS string))"
    f" ELSE concat('ppm-{TOKEN_TIME}-', cast(c_custkey AS string)) END",
    "version": "CASE WHEN c_nationkey = 3 THEN '' ELSE '1.0' END",
    "issued_at": f"CASE WHEN c_nationkey = 11 THEN NULL ELSE '{TOKEN_TIME}' END",
    "ftype": "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'outcome_gap' ELSE 'concentration_risk' END",
    "summary": "concat('Balance of ', c_name, ' stands at ', cast(cast(c_acctbal AS decimal(18,2)) AS string),"
    " CASE WHEN c_mktsegment = 'MACHINERY' THEN '.' WHEN c_mktsegment = 'BUILDING' THEN '! ' ELSE '' END)",
    "entity_id": "concat('general.entities.', cast(c_custkey AS string))",
    "subject_name": "CASE WHEN c_mktsegment = 'MACHINERY' THEN concat(c_name, ' Shipping & Co.')"
    " WHEN c_mktsegment = 'FURNITURE' THEN concat('AIA ', c_name) ELSE c_name END",
    "bn": f"CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE {C9} END",
    "coverage_text": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'ab' WHEN c_nationkey < 5 THEN 'cra' ELSE 'cra,fed' END",
    "score": SCORE,
    "label": f"CASE WHEN {SCORE} >= 21 THEN 'CRITICAL' WHEN {SCORE} >= 15 THEN 'HIGH' WHEN {SCORE} >= 7 THEN 'MEDIUM' ELSE 'LOW' END",
    "filters_text": "CASE WHEN c_nationkey = 13 THEN NULL ELSE 'latest amendment,business number root' END",
    "model": "CASE WHEN c_nationkey = 17 THEN NULL ELSE 'rules' END",
    "prompt_version": "CASE WHEN c_nationkey = 19 THEN '' ELSE 'v1.2' END",
    "calibration": "CASE WHEN c_acctbal > 9500 THEN 'failed' ELSE 'passed' END",
    "citation_count": "CASE WHEN c_nationkey = 2 THEN NULL ELSE cast(length(c_mktsegment) AS int) END",
    "quote_max": "CASE WHEN c_nationkey = 4 THEN NULL ELSE cast(c_nationkey - 6 AS int) END",
    "tier1_passed": "c_nationkey <> 23",
    "tier3_passed": "c_acctbal <= 9500",
    "token_hash": "CASE WHEN c_nationkey = 9 THEN NULL ELSE concat('sha256:t', cast(c_custkey AS string)) END",
    "previous_hash": "CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('sha256:t', cast(c_nationkey * 75 AS string))"
    " WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'sha256:none' END",
    "operator": "CASE WHEN c_acctbal < -990 THEN '' ELSE 'desk' END",
    "disclaimer_text": "CASE WHEN c_nationkey = 21 THEN 'Data current as of 2024-01-01'"
    " ELSE 'Data current as of 2024-01-01|These are observations from public records. They are not findings of misconduct.' END",
    "headline_value": "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE cast(c_acctbal AS decimal(28,6)) END",
    "updated_nation": "c_nationkey",
}
TOKENS_SQL = _sql(TOKENS, "customer")

REGISTER = {
    "aiaId": "concat('A', cast(p_partkey AS string))",
    "systemName": "p_name",
    "department": "p_brand",
    "impactLevel": "cast(ceil(p_size / 12.5) AS int)",
    "mitigationScore": "cast(floor(p_retailprice - 900) AS int)",
}
REGISTER_SQL = _sql(REGISTER, "part")

# Prose: one brief per document, one sentence per line. Lines under 90 characters stand in curly
# quotes; a phrase that the language rules look for is added for some sources.
SUMMARY = (
    "concat('Records of ', source, ' hold ', cast(n_chars AS string), ' characters. ', CASE"
    " WHEN source = 'src3' THEN 'The filing allegedly led to a second contract.'"
    " WHEN source = 'src7' THEN 'Clearly shows growth because of new funding from the program'"
    " WHEN source = 'src11' THEN 'Officials failed to file. Aid came in exchange for support. It WARRANTS INVESTIGATION'"
    " WHEN source = 'src15' THEN 'The dataset shows contributions between 2017 and 2024.' ELSE '' END)"
)
PROSE = {"doc_id": "doc_id", "lang": "lang", "source": "source", "n_chars": "n_chars", "text": "text", "summary": SUMMARY}


def grants(spark: SparkSession, d: str) -> DataFrame:
    return _frame(table(spark, d, "orders"), GRANTS)


def entities(spark: SparkSession, d: str) -> DataFrame:
    df = _frame(table(spark, d, "customer"), ENTITIES)
    return df.withColumn("dataset_sources", F.split("sources_text", ",")).withColumn(
        "addresses", F.transform(F.split("postal_text", ","), lambda p: F.struct(p.alias("postal_code")))
    ).drop("sources_text", "postal_text")


def loops(spark: SparkSession, d: str) -> DataFrame:
    bought = _frame(table(spark, d, "events").filter("event_type = 'purchase'"), PURCHASES)
    grouped = bought.groupBy("bn")
    return grouped.agg(*[F.expr(e).alias(n) for n, e in LOOPS.items() if n not in ("bn", "legal_name")]).withColumn(
        "legal_name", F.expr(LOOPS["legal_name"])
    )


def violations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error'").selectExpr(f"{USER9} AS bn")


def payments(spark: SparkSession, d: str) -> DataFrame:
    return _frame(table(spark, d, "events"), PAYMENTS)


def register(spark: SparkSession, d: str) -> DataFrame:
    return _frame(table(spark, d, "part"), REGISTER)


def flat_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _frame(table(spark, d, "customer"), TOKENS)


def evidence(source: str, row_id: str, field: str, number: str | None) -> Column:
    return F.struct(
        F.lit(source).alias("source"), F.col(row_id).cast("string").alias("row_id"), F.lit(field).alias("field"),
        F.lit(None).cast("string").alias("value_str"), F.col(number).cast("decimal(28,6)").alias("value_num"),
        F.lit("2024-01-01").alias("as_of"),
    )


def tiers() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.struct(
            F.col("tier1_passed").alias("passed"), F.lit(1).alias("tier"), F.split("filters_text", ",").alias("filtersApplied"),
            F.array(F.lit("F-1"), F.lit("F-3")).alias("knownDataIssuesRespected"), none.alias("rejected"),
        ).alias("input"),
        F.struct(
            F.lit(True).alias("passed"), F.lit(2).alias("tier"), F.col("model"), F.lit("sha256:p").alias("promptHash"),
            F.col("prompt_version").alias("promptVersion"), F.lit(0.0).alias("temperature"), F.lit(0).alias("tokensIn"), F.lit(0).alias("tokensOut"),
        ).alias("contextual"),
        F.struct(
            F.col("tier3_passed").alias("passed"), F.lit(3).alias("tier"), F.col("calibration").alias("calibrationCheck"),
            F.col("citation_count").alias("citationCount"), F.col("quote_max").alias("quoteWordCountMax"),
            F.lit(0).alias("uniqueSourcesQuoted"), none.alias("languageViolations"),
        ).alias("output"),
        F.struct(
            F.lit(True).alias("passed"), F.lit(4).alias("tier"), F.col("token_hash").alias("tokenHash"),
            F.col("previous_hash").alias("previousTokenHash"), F.lit(False).alias("humanReviewed"),
            F.lit(None).cast("string").alias("humanReviewer"), F.col("operator").alias("operatorAgent"), F.lit("log").alias("logRef"),
        ).alias("audit"),
    )


def finding() -> Column:
    return F.struct(
        F.col("ftype").alias("type"), F.col("summary"),
        F.struct(
            F.col("entity_id").alias("entityId"), F.col("subject_name").alias("canonicalName"), F.col("bn").alias("bnRoot"),
            F.split("coverage_text", ",").alias("datasetCoverage"),
        ).alias("subject"),
        F.col("score"), F.lit("0-30").alias("scoreScale"), F.col("label").alias("scoreLabel"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """custkey and proofToken; every fourteenth nation's customers carry no token at all."""
    flat = flat_tokens(spark, d)
    token = F.struct(
        F.col("proof_id").alias("proofId"), F.col("version"), F.col("issued_at").alias("issuedAt"), F.lit("issuer").alias("issuedBy"),
        finding().alias("finding"),
        F.array(evidence("general.customers", "custkey", "c_acctbal", "headline_value")).alias("evidence"),
        tiers().alias("tiers"), F.split("disclaimer_text", "\\|").alias("disclaimers"), F.lit("/proof/rerun").alias("rerunUrl"),
    )
    return flat.select("custkey", F.when(F.col("updated_nation") != 14, token).alias("proofToken"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    df = tokens(spark, d).filter(F.col("proofToken").isNotNull() & F.col("proofToken")["proofId"].isNotNull())
    return df.withColumn("indicatorCount", F.length(F.col("proofToken")["finding"]["summary"]).cast("int"))


# Documents of these sources leave a list out: their sections, their claims, their sources.
NO_SECTIONS, NO_CLAIMS, NO_SOURCES = "src2", "src5", "src3"


def brief_lines() -> Column:
    """Sentences of a document: quoted when short, citing by their length; blank lines have no citations at all."""
    def sentence(line):
        short = (F.length(line) < 90) & (F.length(line) > 0)
        n = F.length(line)
        cites = F.when(n != 0, F.array(F.concat(F.lit("src-"), (n % 7).cast("string"))))
        return F.struct(
            F.when(short, F.concat(F.lit("“"), line, F.lit("”"))).otherwise(line).alias("text"), cites.alias("citations")
        )

    return F.transform(F.split("text", "\n"), sentence)


def briefs(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """Briefs of documents; spread where each text is worked on."""
    docs = texts(spark, d, "documents")
    df = _frame(spread_texts(docs, "doc_id", "text") if spread else docs, PROSE)
    source_ids = F.sequence(F.lit(0), F.lit(4))
    subject = F.struct(
        F.concat(F.lit("documents."), F.col("doc_id").cast("string")).alias("entityId"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" of "), F.col("source")).alias("canonicalName"),
        F.lit(None).cast("string").alias("bnRoot"), F.array(F.lit("fed")).alias("datasetCoverage"),
    )
    token = F.struct(
        F.concat(F.lit(f"ppm-{TOKEN_TIME}-d"), F.col("doc_id").cast("string")).alias("proofId"), F.lit("1.0").alias("version"),
        F.lit(TOKEN_TIME).alias("issuedAt"), F.lit("issuer").alias("issuedBy"),
        F.struct(
            F.lit("custom").alias("type"), F.col("summary"), subject.alias("subject"),
            F.least(F.lit(30), F.floor(F.col("n_chars") / 200)).cast("int").alias("score"), F.lit("0-30").alias("scoreScale"),
            F.lit("LOW").alias("scoreLabel"),
        ).alias("finding"),
        F.array(evidence("general.documents", "doc_id", "n_chars", "n_chars")).alias("evidence"),
        F.lit(None).alias("_tiers"),
    )
    flat = df.withColumn("tier1_passed", F.lit(True)).withColumn("tier3_passed", F.lit(True))
    flat = flat.withColumn("filters_text", F.lit("none")).withColumn("model", F.lit("rules")).withColumn("prompt_version", F.lit("v1"))
    flat = flat.withColumn("calibration", F.lit("passed")).withColumn("citation_count", F.lit(3))
    flat = flat.withColumn("quote_max", F.when(F.col("lang") == "es", 15).otherwise(4))
    flat = flat.withColumn("token_hash", F.concat(F.lit("sha256:d"), F.col("doc_id").cast("string")))
    flat = flat.withColumn("previous_hash", F.lit(None).cast("string")).withColumn("operator", F.lit("desk"))
    token = token.withField("tiers", tiers()).dropFields("_tiers").withField(
        "disclaimers", F.array(F.lit("These are observations from public records."))
    ).withField("rerunUrl", F.lit("/proof/rerun"))
    return flat.select(
        "doc_id",
        F.concat(F.lit("ob-"), F.col("doc_id").cast("string")).alias("briefId"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
        F.when(F.col("lang") == "en", "outcome").otherwise("counterfactual").alias("briefType"),
        subject.alias("subject"),
        F.struct(
            F.col("n_chars").cast("decimal(18,2)").alias("totalAgreementValue"), F.lit(0).alias("amendmentCount"),
            F.when(F.col("lang") != "fr", F.array(F.col("source"))).otherwise(F.array().cast("array<string>")).alias("awardingDepartments"),
        ).alias("governmentRecords"),
        F.when(F.col("source") != NO_SECTIONS, F.array(F.struct(F.col("source").alias("sectionHeading"), brief_lines().alias("sentences")))).alias("publicSources"),
        F.when(
            F.col("source") != NO_CLAIMS, F.array(F.struct(F.lit("Funded outcomes").alias("claim"), F.lit("cannot be assessed").alias("rationale")))
        ).alias("unverifiable"),
        F.when(F.col("lang") == "de", F.struct(F.lit("Records are definitely kept.").alias("text"))).alias("pullQuote"),
        F.when(F.col("source") != NO_SOURCES, F.transform(
            source_ids,
            lambda i: F.struct(
                F.concat(F.lit("src-"), i.cast("string")).alias("id"), F.lit("news").alias("kind"),
                F.concat(F.lit("Source "), i.cast("string")).alias("title"),
                F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/"), i.cast("string")).alias("url"),
                (F.lit(2020) + i).cast("int").alias("year"), F.lit("2024-01-01").alias("retrievalDate"), (i + 1).cast("int").alias("authorityTier"),
            ),
        )).alias("sources"),
        token.alias("proofToken"),
    )


# The same briefs for the checks: one row per sentence.
PROSE_SQL = _sql(PROSE, "documents")
SENTENCES_SQL = f"""
    SELECT doc_id, source, lang, n AS sentence_no,
           CASE WHEN length(line) < 90 AND length(line) > 0 THEN concat('“', line, '”') ELSE line END AS text,
           CASE WHEN length(line) = 0 THEN NULL ELSE concat('src-', cast(length(line) % 7 AS string)) END AS citation
    FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n
          FROM documents WHERE source <> '{NO_SECTIONS}')"""
UNRESOLVED_SQL = f"(citation IN ('src-5', 'src-6') OR source = '{NO_SOURCES}')"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a sentence table: assistant turns are quoted whole; citations name earlier speakers."""
    df = table(spark, d, "conversations")
    text = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("“"), F.col("text"), F.lit("”")))
        .when(F.col("role") == "system", F.concat(F.lit('As noted "'), F.col("text"), F.lit('" and ‘so on’.')))
        .otherwise(F.col("text"))
    )
    cites = F.when(F.col("role") == "user", F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("t"), F.col("role")), F.concat(F.lit("c"), (F.length("text") % 5).cast("string")))
    )
    return df.select(F.col("conv_id").alias("brief_id"), F.col("turn").alias("sentence_no"), text.alias("text"), cites.alias("citations"))


def turn_sources(spark: SparkSession, d: str) -> DataFrame:
    """Known sources of a conversation: its roles, and c0 to c2 while it has a system turn."""
    df = table(spark, d, "conversations")
    roles = df.select(F.col("conv_id").alias("brief_id"), F.concat(F.lit("t"), F.col("role")).alias("source_id"))
    systems = df.filter("role = 'system'").select(
        F.col("conv_id").alias("brief_id"), F.explode(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"))).alias("source_id")
    )
    return roles.unionByName(systems)


TURNS_SQL = """
    SELECT conv_id AS brief_id, turn AS sentence_no,
           CASE WHEN role = 'assistant' THEN concat('“', text, '”')
                WHEN role = 'system' THEN concat('As noted "', text, '" and ‘so on’.') ELSE text END AS text,
           CASE WHEN role = 'user' THEN [] ELSE [concat('t', role), concat('c', cast(length(text) % 5 AS string))] END AS citations
    FROM conversations"""
TURN_SOURCES_SQL = """
    SELECT conv_id AS brief_id, concat('t', role) AS source_id FROM conversations
    UNION SELECT conv_id, unnest(['c0', 'c1', 'c2']) FROM conversations WHERE role = 'system'"""
