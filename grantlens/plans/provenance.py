"""Queries over provenance tokens, finding cards and document files, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import provenance as fp
from ..functions import scalar
from ..operators import briefs, dossier, tokens
from ..session import shared_path
from ..sources import documents
from . import inputs as i
from .spending import DOSSIER_SQL, _dossiers, _label_case

# --- completeness and verification ------------------------------------------------------------

VALID = "updated_nation <> 14"
RULES = (
    ("proofId missing or malformed", "proof_id IS NULL OR NOT starts_with(proof_id, 'ppm-')"),
    ("version missing", "coalesce(version, '') = ''"),
    ("issuedAt missing", "coalesce(issued_at, '') = ''"),
    ("finding.summary missing", "coalesce(summary, '') = ''"),
    ("tier 1 (input) filters missing", "filters_text IS NULL"),
    ("tier 2 (contextual) model/promptVersion missing", "coalesce(model, '') = '' OR coalesce(prompt_version, '') = ''"),
    ("tier 3 (output) calibration not passed or citationCount missing", "citation_count IS NULL OR calibration <> 'passed'"),
    ("tier 3 quoteWordCountMax >= 15", "quote_max >= 15"),
    ("tier 4 (audit) tokenHash/operator missing", "coalesce(token_hash, '') = '' OR coalesce(operator, '') = ''"),
    ("disclaimers must include the 'observations from public records' line", "NOT contains(disclaimer_text, 'observations from public records')"),
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_sql() -> str:
    parts = ["SELECT custkey, 'PROOF_INCOMPLETE' AS type, 'No Proof token attached to the output.' AS detail FROM t WHERE updated_nation = 14"]
    for detail, test in RULES:
        kind = "QUOTE_TOO_LONG" if "quoteWordCountMax" in detail else "PROOF_INCOMPLETE"
        parts.append(f"SELECT custkey, '{kind}', {_q(detail)} FROM t WHERE {VALID} AND ({test})")
    return " UNION ALL ".join(parts)


T = f"WITH t AS ({i.TOKENS_SQL}), broken AS ({_rules_sql()})"


def token_completeness(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_completeness(i.tokens(spark, d), id_cols=["custkey"])


def verify_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.verify_tokens(i.tokens(spark, d).filter(F.col("proofToken").isNotNull()), id_cols=["custkey"])


# --- issuing, chaining, audits ----------------------------------------------------------------

AS_OF = "2024-01-01"


def issue_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One token per order, evidenced by its price."""
    o = i.table(spark, d, "orders")
    flat = o.select(
        F.col("o_orderkey").alias("key"),
        F.struct(
            F.lit("amendment_creep").alias("type"), F.concat(F.lit("Order of "), F.col("o_orderpriority")).alias("summary"),
            F.struct(
                F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entityId"), F.lit("Buyer").alias("canonicalName"),
                F.when(F.col("o_orderstatus") == "P", F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("bnRoot"),
                F.array(F.lit("fed")).alias("datasetCoverage"),
            ).alias("subject"),
            F.lit(12).alias("score"), F.lit("0-30").alias("scoreScale"), F.lit("MEDIUM").alias("scoreLabel"),
        ).alias("finding"),
        F.array(i.evidence("orders", "o_orderkey", "o_totalprice", "o_totalprice")).alias("evidence"),
        F.struct(
            F.struct(F.lit(True).alias("passed"), F.lit(1).alias("tier"), F.array(F.lit("latest")).alias("filtersApplied")).alias("input"),
            F.struct(F.lit(True).alias("passed"), F.lit(4).alias("tier"), F.lit("").alias("tokenHash"), F.lit(None).cast("string").alias("previousTokenHash")).alias("audit"),
        ).alias("tiers"),
    )
    t = F.col("proofToken")
    issued = tokens.issue_tokens(flat, AS_OF, i.TOKEN_TIME)
    return issued.select("key", t["proofId"].alias("proof_id"), t["tiers"]["audit"]["tokenHash"].alias("token_hash"), F.element_at(t["disclaimers"], 1).alias("disclaimer"))


ISSUE_SQL = f"""WITH o AS (SELECT *, concat('[{{"source":"orders","row_id":"', o_orderkey, '","field":"o_totalprice","value_str":null,"value_num":',
        cast(cast(o_totalprice AS decimal(28,6)) AS varchar), ',"as_of":"2024-01-01"}}]') AS ev FROM orders),
    p AS (SELECT *, concat('ppm-{i.TOKEN_TIME}-', substr(sha256(concat('c', o_custkey, '|amendment_creep|', sha256(ev))), 1, 6)) AS proof_id FROM o)
    SELECT o_orderkey AS key, proof_id, concat('sha256:', sha256(concat('{{"proofId":"', proof_id,
        '","version":"1.0","issuedAt":"{i.TOKEN_TIME}","issuedBy":"issuer","finding":{{"type":"amendment_creep","summary":"Order of ', o_orderpriority,
        '","subject":{{"entityId":"c', o_custkey, '","canonicalName":"Buyer","bnRoot":',
        CASE WHEN o_orderstatus = 'P' THEN concat('"', lpad(cast(o_custkey AS varchar), 9, '0'), '"') ELSE 'null' END,
        ',"datasetCoverage":["fed"]}},"score":12,"scoreScale":"0-30","scoreLabel":"MEDIUM"}},"evidence":', ev,
        ',"tiers":{{"input":{{"passed":true,"tier":1,"filtersApplied":["latest"]}},"audit":{{"passed":true,"tier":4,"tokenHash":"","previousTokenHash":null}}}},',
        '"disclaimers":["Data current as of 2024-01-01","Entity resolution is probabilistic for cross-dataset matches without BN anchor",',
        '"These are observations from public records. They are not findings of misconduct."],"rerunUrl":"/proof/rerun/', proof_id, '"}}'))) AS token_hash,
        'Data current as of 2024-01-01' AS disclaimer FROM p"""

# Weights and reasons follow each customer's nation and segment.
REASON = (
    "CASE WHEN c_mktsegment = 'FURNITURE' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'The donor allegedly failed to report'"
    " WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE concat('Weights reviewed for nation ', cast(c_nationkey AS string)) END"
)
WEIGHTS_TEXT = (
    "CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 10 THEN concat('fc:', cast(c_nationkey AS string), ',cl:2,zz:1,fc:', cast(c_nationkey - 4 AS string), '.5')"
    " WHEN c_nationkey < 15 THEN 'tv:99,dc:-3,cl:' WHEN c_nationkey < 20 THEN 'fc:abc,tv,dc: 7 ' ELSE concat('fc:8,cl:5,tv:7,dc:', cast(c_nationkey - 15 AS string)) END"
)


def _links(spark: SparkSession, d: str) -> DataFrame:
    c = i.table(spark, d, "customer")
    return c.selectExpr("c_custkey AS custkey", f"{REASON} AS reason", f"{WEIGHTS_TEXT} AS w")


def weights_codec(spark: SparkSession, d: str) -> DataFrame:
    df = _links(spark, d).withColumn("decoded", fp.decode_weights("w"))
    return df.select("custkey", "decoded.*", fp.encode_weights("decoded").alias("code"), fp.weight_total("decoded").alias("total"))


def chain_tokens(spark: SparkSession, d: str) -> DataFrame:
    df = i.tokens(spark, d).filter("proofToken.proofId IS NOT NULL").join(_links(spark, d), "custkey")
    df = df.withColumn("decoded", fp.decode_weights("w"))
    out = tokens.chain_tokens(df, weights="decoded", issued_at=i.TOKEN_TIME, keep_rejected=True)
    t = F.col("proofToken")
    return out.select(
        "custkey", t["proofId"].alias("proof_id"), t["finding"]["score"].alias("score"), t["finding"]["scoreLabel"].alias("label"),
        t["finding"]["summary"].alias("summary"), t["tiers"]["output"]["calibrationCheck"].alias("calibration"),
        F.array_join(t["tiers"]["output"]["languageViolations"], ";").alias("language"),
        t["tiers"]["audit"]["previousTokenHash"].alias("previous_hash"), t["tiers"]["audit"]["tokenHash"].alias("token_hash"),
        t["tiers"]["audit"]["logRef"].alias("log_ref"),
    )


def poly_hash(spark: SparkSession, d: str) -> DataFrame:
    p = i.table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select("page_id", fp.poly31_hex("url").alias("url_hash"), fp.poly31_hex(title).alias("title_hash"))


# Which tokens are sealed at all, and which were altered afterwards, by nation.
SEALED, ALTERED = "n % 2 = 0", "n % 3 = 0"


def chain_audit(spark: SparkSession, d: str) -> DataFrame:
    """Some tokens carry their seal, some of these were altered since, the others carry another hash."""
    nations = i.table(spark, d, "customer").selectExpr("c_custkey AS custkey", "c_nationkey AS n")
    raw = i.tokens(spark, d).filter("proofToken IS NOT NULL").join(nations, "custkey")
    own = F.col("proofToken")["tiers"]["audit"]["tokenHash"]
    hashed = F.when(F.expr(SEALED), fp.token_seal("proofToken")).otherwise(own)
    mixed = raw.withColumn("proofToken", F.col("proofToken").withField("tiers.audit.tokenHash", hashed))
    score = F.col("proofToken")["finding"]["score"]
    changed = F.when(F.expr(ALTERED), score + 1).otherwise(score)
    audit = tokens.chain_audit(mixed.withColumn("proofToken", F.col("proofToken").withField("finding.score", changed)))
    shown = F.when(F.col("token_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit("sealed")).otherwise(F.col("token_hash"))
    return audit.withColumn("token_hash", shown).withColumns({c: F.col(c).cast("string") for c in ("seal_holds", "parent_found")})


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    return tokens.parent_links(i.tokens(spark, d).filter("proofToken IS NOT NULL"))


def _poly_sql(text: str) -> str:
    """The hash folded over code points; the tables hold no text beyond the basic plane."""
    return (
        f"CASE WHEN length({text}) = 0 THEN '00000000' ELSE lpad(lower(hex(list_reduce(list_prepend(cast(0 AS bigint), "
        f"list_transform(string_split({text}, ''), lambda x: cast(unicode(x) AS bigint))), lambda a, b: (a * 31 + b) % 4294967296))), 8, '0') END"
    )


DECODED_SQL = f"""links AS (SELECT c_custkey AS custkey, {REASON} AS reason, {WEIGHTS_TEXT} AS w, c_nationkey AS n FROM customer),
    decoded AS (SELECT custkey, reason, w,
        cast(CASE WHEN n BETWEEN 5 AND 9 THEN n - 4 + 1 WHEN n >= 20 THEN 8 ELSE 6 END AS int) AS federal_concentration,
        cast(CASE WHEN n BETWEEN 5 AND 9 THEN 2 WHEN n BETWEEN 10 AND 14 THEN 0 ELSE 5 END AS int) AS cra_loops,
        cast(CASE WHEN n BETWEEN 10 AND 14 THEN 10 WHEN n >= 20 THEN 7 ELSE 4 END AS int) AS t3010_violations,
        cast(CASE WHEN n BETWEEN 10 AND 14 THEN 0 WHEN n BETWEEN 15 AND 19 THEN 7 WHEN n >= 20 THEN n - 15 ELSE 3 END AS int) AS dataset_cross_coverage
        FROM links),
    coded AS (SELECT *, concat('fc:', federal_concentration, ',cl:', cra_loops, ',tv:', t3010_violations, ',dc:', dataset_cross_coverage) AS code,
        federal_concentration + cra_loops + t3010_violations + dataset_cross_coverage AS total FROM decoded)"""

CHAIN_SQL = f"""WITH t AS ({i.TOKENS_SQL}), {DECODED_SQL},
    j AS (SELECT t.*, c.* EXCLUDE (custkey), coalesce(reason, '') AS why FROM t JOIN coded c USING (custkey) WHERE {VALID} AND proof_id IS NOT NULL),
    h AS (SELECT *, substr({_poly_sql('''concat(proof_id, '|{"federal_concentration":', federal_concentration, ',"cra_loops":', cra_loops,
        ',"t3010_violations":', t3010_violations, ',"dataset_cross_coverage":', dataset_cross_coverage, '}|', why)''')}, 1, 6) AS hash,
        why <> '' AND NOT contains(why, 'allegedly') AS ok,
        cast(greatest(0, least(30, floor(score * (cast(total AS double) / 18) + 0.5))) AS int) AS new_score FROM j)
    SELECT custkey, concat('ppm-{i.TOKEN_TIME}-chain-', hash) AS proof_id, new_score AS score, {_label_case('new_score')} AS label,
        concat(regexp_replace(summary, '[.!?]\\s*$', ''), ' — re-scored under adjusted weights, sensitivity reason logged.') AS summary,
        CASE WHEN ok THEN 'passed' ELSE 'failed' END AS calibration,
        CASE WHEN ok THEN '' ELSE concat('chainReason flagged ', CASE WHEN why = '' THEN 0 ELSE 2 END, ' calibration violation(s)') END AS language,
        token_hash AS previous_hash, concat('sha256:chain-', hash, '-pending-seal') AS token_hash,
        concat('decisions.md#chain-', hash, ' (rationale: ', substr(why, 1, 80), ')') AS log_ref FROM h"""

# --- look-ups ---------------------------------------------------------------------------------


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Finding tokens and brief tokens; a third of the labels' briefs reuse a finding's id."""
    cards = i.findings(spark, d)
    written = i.briefs(spark, d).withColumn(
        "proofToken",
        F.col("proofToken").withField("proofId", F.concat(F.lit(f"ppm-{i.TOKEN_TIME}-"), F.floor(F.col("doc_id") / 2).cast("string"))),
    )
    return tokens.token_registry(cards, written)


def find_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.find_tokens(_registry(spark, d)).select("proof_id", "source", "subject_name")


def _permalinks(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select(
        F.concat(F.lit("link-"), F.col("custkey").cast("string")).alias("link"),
        F.concat(F.lit(f"ppm-{i.TOKEN_TIME}-"), F.col("custkey").cast("string")).alias("id"), "reason", "w",
    ).select(
        F.when(F.col("reason").isNull(), F.col("id")).otherwise(F.col("link")).alias("token_id"),
        F.when(F.col("reason").isNotNull(), F.col("id")).alias("parent"), "w",
    )


def resolve_permalinks(spark: SparkSession, d: str) -> DataFrame:
    return tokens.resolve_permalinks(_permalinks(spark, d), _registry(spark, d))


def evidence_source_audit(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of tokens about nations whose table nobody registered for their region."""
    df = i.tokens(spark, d).filter("proofToken IS NOT NULL")
    source = F.concat(F.lit("general."), F.lower(F.col("proofToken")["finding"]["scoreLabel"]))
    moved = df.withColumn(
        "proofToken",
        F.col("proofToken").withField("evidence", F.transform(F.col("proofToken")["evidence"], lambda e: e.withField("source", source))),
    )
    known = i.table(spark, d, "region").select(F.when(F.col("r_name") == "ASIA", "general.low").otherwise("general.high").alias("source"))
    return tokens.evidence_source_audit(moved, known)


def display_facets(spark: SparkSession, d: str) -> DataFrame:
    out = briefs.display_facets(i.findings(spark, d))
    return out.withColumn("shown", scalar.format_value("headline_value", "headline_source")).withColumn("headline_value", F.col("headline_value").cast("double"))


def feed_search(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("proofToken")
    out = briefs.feed(i.findings(spark, d), "  SHIPPING & co. ", "score")
    return out.select(t["proofId"].alias("proof_id"), t["finding"]["score"].alias("score"), "indicatorCount")


def feed_by_name(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("proofToken")
    return briefs.feed(i.findings(spark, d), "", "name").select(t["finding"]["subject"]["canonicalName"].alias("name"))


def finding_by_slug(spark: SparkSession, d: str) -> DataFrame:
    asked = i.table(spark, d, "supplier").select(
        F.concat(F.lit("customer-"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"), F.lit("-shipping-and-co")).alias("slug")
    )
    return briefs.finding_by_slug(i.findings(spark, d), asked).select("custkey", "slug")


# --- files ------------------------------------------------------------------------------------


def token_export(spark: SparkSession, d: str) -> DataFrame:
    """Exported JSON, with the envelope read back out of it."""
    out = documents.export_tokens(
        i.tokens(spark, d).filter("proofToken.proofId IS NOT NULL"), "Issuer", "https://example.org/verify/", "Checks every gate again."
    )
    read = lambda p: F.get_json_object("body", p)
    return out.select(
        "proof_id", "file_name", read("$._verifiability.verifyAt").alias("verify_at"), read("$._verifiability.issuedAt").alias("issued_at"),
        read("$.finding.score").cast("int").alias("score"), read("$.tiers.audit.previousTokenHash").alias("previous_hash"),
    )


def dossier_sink(spark: SparkSession, d: str) -> DataFrame:
    """Dossiers written as JSON documents and read back."""
    out = dossier.nest_dossiers(_dossiers(spark, d))
    path = shared_path(spark, "dossiers")
    documents.write_dossiers(out, path, i.TOKEN_TIME)
    schema = out.withColumn("cachedAt", F.lit("")).schema
    back = documents.read_dossiers(spark, path, schema)
    return back.select(
        "entity_id", F.size("agreements").alias("agreements"), F.col("fed_summary.total_current_commitment").cast("double").alias("total"), "cachedAt"
    )


def document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Briefs and finding cards written as JSON, read with the document readers, evidence split again."""
    path = shared_path(spark, "briefs")
    raw = i.briefs(spark, d)
    token = F.col("proofToken")
    as_file = token.withField(
        "evidence",
        F.transform(
            token["evidence"],
            lambda e: F.struct(
                e["source"].alias("source"), e["row_id"].alias("rowId"), e["field"].alias("field"),
                F.when(F.length(e["row_id"]) > 2, e["value_num"].cast("bigint")).alias("value"), e["as_of"].alias("asOf"),
            ),
        ),
    )
    raw.drop("doc_id", "slug").withColumn("proofToken", as_file).write.mode("overwrite").json(path)
    back = documents.read_briefs(spark, path, one_per_line=True)
    first = F.col("proofToken")["evidence"][0]
    return back.select(
        "briefId", "briefType", F.size(F.col("publicSources")[0]["sentences"]).alias("sentences"), first["row_id"].alias("row_id"),
        first["value_num"].cast("double").alias("value_num"), first["value_str"].alias("value_str"),
        F.col("proofToken")["proofId"].alias("proof_id"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        token_completeness, verify_tokens, issue_tokens, weights_codec, chain_tokens, poly_hash, chain_audit, parent_links, find_tokens,
        resolve_permalinks, evidence_source_audit, display_facets, feed_search, feed_by_name, finding_by_slug, token_export,
        dossier_sink, document_scan,
    )
}

FINDINGS = f"{VALID} AND proof_id IS NOT NULL"
REG_SQL = f"""reg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proof_id ORDER BY prio, tie, subject_name) AS rn FROM (
        SELECT proof_id, 'finding' AS source, 0 AS prio, subject_name, '' AS tie, score, label FROM t WHERE {FINDINGS}
        UNION ALL SELECT concat('ppm-{i.TOKEN_TIME}-', doc_id // 2), 'brief', 1, concat('Document ', doc_id, ' of ', source), concat('ob-', doc_id),
            cast(least(30, floor(n_chars / 200)) AS int), 'LOW' FROM documents)) WHERE rn = 1)"""

ORACLES = {
    "token_completeness": T + " SELECT custkey, type, detail FROM broken",
    "verify_tokens": T + f""" SELECT t.custkey, proof_id, coalesce(n, 0) AS violation_count, coalesce(n, 0) = 0 AS passed,
        CASE WHEN tier1_passed AND tier3_passed AND label NOT IN ('HIGH', 'CRITICAL') THEN 'sage' ELSE 'ember' END AS badge,
        tier1_passed AS input_passed, 'Filters: ' || replace(filters_text, ',', ', ') AS input_detail, true AS context_passed,
        'Model: ' || model || ' · prompt ' || prompt_version AS context_detail, tier3_passed AS output_passed,
        citation_count || ' citations · max-quote ' || quote_max || ' words · calibration ' || calibration AS output_detail, true AS audit_passed,
        'Operator ' || operator || '; ' || CASE WHEN previous_hash IS NULL THEN 'unchained' ELSE 'chained' END AS audit_detail
        FROM t LEFT JOIN (SELECT custkey, cast(count(*) AS int) AS n FROM broken GROUP BY 1) b USING (custkey) WHERE {VALID}""",
    "issue_tokens": ISSUE_SQL,
    "weights_codec": f"WITH {DECODED_SQL} SELECT custkey, federal_concentration, cra_loops, t3010_violations, dataset_cross_coverage, code, total FROM coded",
    "chain_tokens": CHAIN_SQL,
    "poly_hash": f"""SELECT page_id, {_poly_sql('url')} AS url_hash, {_poly_sql('title')} AS title_hash
        FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""",
    "chain_audit": f"""WITH t AS (SELECT * REPLACE (CASE WHEN {SEALED} THEN 'sealed' ELSE token_hash END AS token_hash)
            FROM (SELECT *, updated_nation AS n FROM ({i.TOKENS_SQL})) WHERE {VALID}) SELECT proof_id, token_hash, previous_hash,
        CASE WHEN {SEALED} THEN CASE WHEN {ALTERED} THEN 'false' ELSE 'true' END WHEN token_hash IS NOT NULL THEN 'false' END AS seal_holds,
        CASE WHEN previous_hash IS NULL THEN NULL WHEN previous_hash IN (SELECT token_hash FROM t WHERE token_hash IS NOT NULL) THEN 'true' ELSE 'false' END AS parent_found FROM t""",
    "parent_links": f"""WITH t AS (SELECT * FROM ({i.TOKENS_SQL}) WHERE {VALID}) SELECT c.proof_id AS child_id, p.proof_id AS parent_id
        FROM t c JOIN t p ON c.previous_hash = p.token_hash""",
    "find_tokens": f"WITH t AS ({i.TOKENS_SQL}), {REG_SQL} SELECT proof_id, source, subject_name FROM reg",
    "resolve_permalinks": f"""WITH t AS ({i.TOKENS_SQL}), {DECODED_SQL}, {REG_SQL},
        l AS (SELECT concat('ppm-{i.TOKEN_TIME}-', custkey) AS proof_id, custkey, reason, code, total FROM coded),
        j AS (SELECT *, cast(greatest(0, least(30, floor(score * (cast(total AS double) / 18) + 0.5))) AS int) AS new_score FROM l JOIN reg USING (proof_id))
        SELECT CASE WHEN reason IS NULL THEN proof_id ELSE concat('link-', custkey) END AS token_id, proof_id, subject_name, reason IS NOT NULL AS is_chained,
        code AS weights_code, CASE WHEN reason IS NULL THEN score ELSE new_score END AS score,
        CASE WHEN reason IS NULL THEN label ELSE {_label_case('new_score')} END AS label FROM j""",
    "evidence_source_audit": f"""WITH t AS ({i.TOKENS_SQL}) SELECT concat('general.', lower(label)) AS source, proof_id, cast(custkey AS varchar) AS row_id,
        'c_acctbal' AS field FROM t WHERE {VALID} AND label NOT IN ('LOW', 'HIGH')""",
    "display_facets": f"""WITH t AS ({i.TOKENS_SQL}) SELECT proof_id,
        CASE WHEN lower(subject_name) LIKE '%aia%' THEN 'aia_system' WHEN lower(subject_name) LIKE '%shipping%' THEN 'contract'
             WHEN coverage_text = 'ab' THEN 'ab_grant' WHEN coverage_text = 'cra' THEN 'charity' ELSE 'fed_grant' END AS entity_kind,
        CASE WHEN lower(subject_name) LIKE '%aia%' OR ftype = 'outcome_gap' THEN 'S3' ELSE 'S4' END AS stratum,
        cast(headline_value AS double) AS headline_value, CASE WHEN headline_value IS NOT NULL THEN 'general.customers' END AS headline_source,
        CASE WHEN headline_value IS NULL THEN '(null)'
             WHEN abs(headline_value) >= 1000 THEN concat('$', format('{{:,}}', cast(round(headline_value, 0) AS bigint)))
             ELSE regexp_replace(regexp_replace(cast(headline_value AS varchar), '0+$', ''), '[.]$', '') END AS shown FROM t WHERE {FINDINGS}""",
    "feed_search": f"""WITH t AS ({i.TOKENS_SQL}) SELECT proof_id, score, cast(length(summary) AS int) AS "indicatorCount" FROM t
        WHERE {FINDINGS} AND contains(lower(concat(subject_name, ' ', summary, ' ', coalesce(bn, ''))), 'shipping & co.')""",
    "feed_by_name": f"WITH t AS ({i.TOKENS_SQL}) SELECT subject_name AS name FROM t WHERE {FINDINGS}",
    "finding_by_slug": f"""WITH t AS ({i.TOKENS_SQL}), f AS (SELECT custkey, regexp_replace(regexp_replace(replace(lower(subject_name), '&', 'and'),
        '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM t WHERE {FINDINGS})
        SELECT custkey, slug FROM f WHERE slug IN (SELECT concat('customer-', lpad(cast(s_suppkey * 3 AS varchar), 9, '0'), '-shipping-and-co') FROM supplier)""",
    "token_export": f"""WITH t AS ({i.TOKENS_SQL}) SELECT proof_id, concat('ppm-', proof_id, '.json') AS file_name,
        concat('https://example.org/verify/', proof_id) AS verify_at, issued_at, score, previous_hash FROM t WHERE {FINDINGS}""",
    "dossier_sink": f"""SELECT entity_id, cast(len(string_split(agreement_ids, ',')) AS int) AS agreements,
        total_current_commitment AS total, '{i.TOKEN_TIME}' AS "cachedAt" FROM ({DOSSIER_SQL})""",
    "document_scan": f"""SELECT concat('ob-', doc_id) AS "briefId", CASE WHEN lang = 'en' THEN 'outcome' ELSE 'counterfactual' END AS "briefType",
        CASE WHEN source <> '{i.NO_SECTIONS}' THEN cast(len(string_split(text, chr(10))) AS int) END AS sentences, cast(doc_id AS varchar) AS row_id,
        CASE WHEN length(cast(doc_id AS varchar)) > 2 THEN cast(n_chars AS double) END AS value_num, NULL AS value_str,
        concat('ppm-{i.TOKEN_TIME}-d', doc_id) AS proof_id FROM documents""",
}
