"""Provenance tokens: completeness, verification, issuing, chaining, audits, look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.provenance import (
    DEFAULT_WEIGHTS,
    decode_weights,
    encode_weights,
    evidence_hash,
    poly31_hex,
    proof_id,
    rescore,
    rescored_summary,
    standard_disclaimers,
    token_seal,
    weights_struct,
    WEIGHT_DIMENSIONS,
)
from ..functions.scalar import ColumnLike, badge_state, col, score_label, uri_encode
from .guards import first_per_key
from .skew import distinct_keys, spread
from .text_checks import VIOLATION, phrase_violations, violation

# The disclaimer every token must carry, the quote limit, and the wording of each
# shortcoming by its kind.
OBSERVATIONS_LINE = "observations from public records"
MAX_TOKEN_QUOTE_WORDS = 15
NO_TOKEN = "No Proof token attached to the output."
SHORTCOMINGS = {
    "id": "proofId missing or malformed",
    "version": "version missing",
    "issued": "issuedAt missing",
    "summary": "finding.summary missing",
    "input": "tier 1 (input) filters missing",
    "context": "tier 2 (contextual) model/promptVersion missing",
    "output": "tier 3 (output) calibration not passed or citationCount missing",
    "quote": "tier 3 quoteWordCountMax >= 15",
    "audit": "tier 4 (audit) tokenHash/operator missing",
    "disclaimer": "disclaimers must include the 'observations from public records' line",
}


def token_violations(token: ColumnLike = "proofToken") -> Column:
    """Completeness rules of a token, in order; a missing token fails with a single row."""
    t = col(token)

    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    tiers = t["tiers"]
    output = tiers["output"]
    fails = {
        "id": ~F.coalesce(t["proofId"].startswith("ppm-"), F.lit(False)),
        "version": blank(t["version"]),
        "issued": blank(t["issuedAt"]),
        "summary": blank(t["finding"]["summary"]),
        "input": F.coalesce(F.size(tiers["input"]["filtersApplied"]), F.lit(-1)) <= 0,
        "context": blank(tiers["contextual"]["model"]) | blank(tiers["contextual"]["promptVersion"]),
        "output": output["citationCount"].isNull() | (F.coalesce(output["calibrationCheck"], F.lit("")) != "passed"),
        "quote": F.coalesce(output["quoteWordCountMax"], F.lit(0)) >= MAX_TOKEN_QUOTE_WORDS,
        "audit": blank(tiers["audit"]["tokenHash"]) | blank(tiers["audit"]["operatorAgent"]),
        "disclaimer": ~F.coalesce(F.array_join(t["disclaimers"], " "), F.lit("")).contains(OBSERVATIONS_LINE),
    }
    found = [
        F.when(fails[kind], violation("QUOTE_TOO_LONG" if kind == "quote" else "PROOF_INCOMPLETE", detail=F.lit(detail)))
        for kind, detail in SHORTCOMINGS.items()
    ]
    listed = F.filter(F.array(*found), lambda v: v.isNotNull()).cast(f"array<{VIOLATION}>")
    absent = F.array(violation("PROOF_INCOMPLETE", detail=F.lit(NO_TOKEN))).cast(f"array<{VIOLATION}>")
    return F.when(t.isNull(), absent).otherwise(listed)


def token_completeness(tokens: DataFrame, token: str = "proofToken", id_cols: Sequence[str] = ()) -> DataFrame:
    return tokens.select(*id_cols, F.inline(token_violations(token))).select(*id_cols, "type", "detail")


def verify_tokens(tokens: DataFrame, token: str = "proofToken", id_cols: Sequence[str] = ()) -> DataFrame:
    """Verdict, violation count, badge, and each tier's flag with its detail line."""
    t = F.col(token)
    tiers = t["tiers"]
    output, context, audit = tiers["output"], tiers["contextual"], tiers["audit"]
    shown = lambda c: c.cast("string")
    return tokens.select(
        *id_cols,
        t["proofId"].alias("proof_id"),
        F.size(token_violations(token)).alias("violation_count"),
        (F.size(token_violations(token)) == 0).alias("passed"),
        badge_state(tiers, t["finding"]["scoreLabel"]).alias("badge"),
        tiers["input"]["passed"].alias("input_passed"),
        F.concat(F.lit("Filters: "), F.array_join(tiers["input"]["filtersApplied"], ", ")).alias("input_detail"),
        context["passed"].alias("context_passed"),
        F.concat(F.lit("Model: "), context["model"], F.lit(" · prompt "), context["promptVersion"]).alias("context_detail"),
        output["passed"].alias("output_passed"),
        F.concat(
            shown(output["citationCount"]), F.lit(" citations · max-quote "), shown(output["quoteWordCountMax"]),
            F.lit(" words · calibration "), output["calibrationCheck"],
        ).alias("output_detail"),
        audit["passed"].alias("audit_passed"),
        F.concat(
            F.lit("Operator "), audit["operatorAgent"], F.lit("; "),
            F.when(F.coalesce(audit["previousTokenHash"], F.lit("")) != "", F.lit("chained")).otherwise(F.lit("unchained")),
        ).alias("audit_detail"),
    )


def seal_tokens(tokens: DataFrame, token: str = "proofToken") -> DataFrame:
    return tokens.withColumn(token, F.col(token).withField("tiers.audit.tokenHash", token_seal(token)))


def issue_tokens(findings: DataFrame, as_of: str, issued_at: str, issued_by: str = "issuer", version: str = "1.0") -> DataFrame:
    """Token per finding row with columns finding, evidence, tiers and rerun_base: id, disclaimers, seal."""
    new_id = proof_id(
        F.col("finding")["subject"]["entityId"], F.col("finding")["type"], evidence_hash("evidence"), F.lit(issued_at)
    )
    token = F.struct(
        new_id.alias("proofId"),
        F.lit(version).alias("version"),
        F.lit(issued_at).alias("issuedAt"),
        F.lit(issued_by).alias("issuedBy"),
        F.col("finding"),
        F.col("evidence"),
        F.col("tiers"),
        standard_disclaimers(F.lit(as_of)).alias("disclaimers"),
        F.concat(F.lit("/proof/rerun/"), new_id).alias("rerunUrl"),
    )
    kept = [c for c in findings.columns if c not in ("finding", "evidence", "tiers")]
    return seal_tokens(findings.select(*kept, token.alias("proofToken")))


# --- chaining ---------------------------------------------------------------------------------


def weights_json(w: ColumnLike) -> Column:
    pairs = [F.concat(F.lit(f'"{name}":'), col(w)[name].cast("string")) for name, _, _ in WEIGHT_DIMENSIONS]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def with_fields(struct: Column, names: Sequence[str], **changes: Column) -> Column:
    """The struct with some fields replaced, spelled out once so that nested updates stay small."""
    return F.struct(*[changes.get(n, struct[n]).alias(n) for n in names])


def chain_tokens(
    parents: DataFrame,
    reason: str = "reason",
    weights: str | None = None,
    issued_at: str = "1970-01-01T00:00:00.000Z",
    issued_by: str = "reviewer",
    log_name: str = "decisions.md",
    token: str = "proofToken",
    keep_rejected: bool = False,
) -> DataFrame:
    """Re-scored child of each token, linked to its parent's hash.

    Only children with a reason free of forbidden phrases are committed; keep_rejected also returns
    the others, marked as failed.
    """
    if weights is None:
        parents = parents.withColumn("_w", weights_struct(DEFAULT_WEIGHTS))
    else:
        parents = parents.withColumn("_w", F.col(weights))
    df = parents.withColumn("_leaks", F.size(phrase_violations(F.coalesce(reason, F.lit("")))))
    committed = (F.coalesce(F.col(reason), F.lit("")) != "") & (F.col("_leaks") == 0)
    if not keep_rejected:
        df = df.filter(committed)
    p = F.col(token)
    shape = parents.schema[token].dataType
    tier_shape = shape["tiers"].dataType
    seed = F.concat_ws("|", p["proofId"], weights_json("_w"), F.coalesce(reason, F.lit("")))
    df = df.withColumn("_hash", F.substring(poly31_hex(seed), 1, 6)).withColumn("_ok", committed)
    df = df.withColumn("_score", rescore(p["finding"]["score"], "_w"))
    flagged = F.array(F.concat(F.lit("chainReason flagged "), F.col("_leaks").cast("string"), F.lit(" calibration violation(s)")))
    finding = with_fields(
        p["finding"], shape["finding"].dataType.fieldNames(),
        score=F.col("_score"), scoreLabel=score_label("_score"), summary=rescored_summary(p["finding"]["summary"]),
    )
    output = with_fields(
        p["tiers"]["output"], tier_shape["output"].dataType.fieldNames(),
        passed=F.col("_ok"),
        calibrationCheck=F.when(F.col("_ok"), F.lit("passed")).otherwise(F.lit("failed")),
        languageViolations=F.when(F.col("_ok"), F.array().cast("array<string>")).otherwise(flagged),
    )
    audit = with_fields(
        p["tiers"]["audit"], tier_shape["audit"].dataType.fieldNames(),
        passed=F.col("_ok"),
        previousTokenHash=p["tiers"]["audit"]["tokenHash"],
        tokenHash=F.concat(F.lit("sha256:chain-"), F.col("_hash"), F.lit("-pending-seal")),
        humanReviewed=F.lit(False),
        humanReviewer=F.lit(None).cast("string"),
        operatorAgent=F.lit(issued_by),
        logRef=F.concat(
            F.lit(f"{log_name}#chain-"), F.col("_hash"), F.lit(" (rationale: "),
            F.substring(F.coalesce(reason, F.lit("")), 1, 80), F.lit(")"),
        ),
    )
    child = with_fields(
        p, shape.fieldNames(),
        proofId=F.concat(F.lit(f"ppm-{issued_at}-chain-"), F.col("_hash")),
        issuedAt=F.lit(issued_at),
        issuedBy=F.lit(issued_by),
        finding=finding,
        tiers=with_fields(p["tiers"], tier_shape.fieldNames(), output=output, audit=audit),
    )
    return df.withColumn(token, child).drop("_w", "_leaks", "_hash", "_ok", "_score")


def permalink(child_id: ColumnLike, parent_id: ColumnLike, w: ColumnLike, reason: ColumnLike) -> Column:
    """Path that reproduces a chained token: parent, weights and reason travel in the query."""
    return F.concat(
        F.lit("/proof/"), col(child_id), F.lit("?parent="), col(parent_id), F.lit("&w="), encode_weights(w),
        F.lit("&reason="), uri_encode(reason),
    )


def chain_audit(tokens: DataFrame, token: str = "proofToken") -> DataFrame:
    """For every token: does its parent hash resolve, and does its own seal still hold."""
    t = F.col(token)
    flat = tokens.select(
        t["proofId"].alias("proof_id"),
        t["tiers"]["audit"]["tokenHash"].alias("token_hash"),
        t["tiers"]["audit"]["previousTokenHash"].alias("previous_hash"),
        (token_seal(token) == t["tiers"]["audit"]["tokenHash"]).alias("seal_holds"),
    )
    roots = flat.filter(F.col("previous_hash").isNull()).withColumn("parent_found", F.lit(None).cast("boolean"))
    children = flat.filter(F.col("previous_hash").isNotNull())
    hashes = distinct_keys(flat.select(F.col("token_hash").alias("previous_hash")), "previous_hash").withColumn("known", F.lit(True))
    linked = children.join(hashes, "previous_hash", "left").withColumn("parent_found", F.coalesce("known", F.lit(False)))
    return roots.unionByName(linked.drop("known"))


def parent_links(tokens: DataFrame, token: str = "proofToken") -> DataFrame:
    """(child_id, parent_id) for every chained token whose parent is present."""
    t = F.col(token)
    flat = tokens.select(
        t["proofId"].alias("id"), t["tiers"]["audit"]["tokenHash"].alias("h"), t["tiers"]["audit"]["previousTokenHash"].alias("p")
    )
    children = flat.filter(F.col("p").isNotNull()).select(F.col("id").alias("child_id"), F.col("p").alias("h"))
    return children.join(flat.select(F.col("id").alias("parent_id"), "h"), "h").select("child_id", "parent_id")


# --- look-ups ---------------------------------------------------------------------------------


def token_registry(findings: DataFrame, briefs: DataFrame) -> DataFrame:
    """All tokens, those of findings ahead of those of briefs."""
    def side(df: DataFrame, source: str, priority: int, name: Column, tie: Column) -> DataFrame:
        return df.select(
            F.col("proofToken")["proofId"].alias("proof_id"),
            F.lit(source).alias("source"),
            F.lit(priority).alias("source_priority"),
            name.alias("subject_name"),
            tie.alias("tie"),
            F.col("proofToken"),
        )

    found = side(findings, "finding", 0, F.col("proofToken")["finding"]["subject"]["canonicalName"], F.lit(""))
    written = side(briefs, "brief", 1, F.col("subject")["canonicalName"], F.col("briefId"))
    return found.unionByName(written)


def find_tokens(registry: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """First token per id: findings before briefs. With ids, only those asked for; a token without an id is never found."""
    if ids is not None:
        registry = registry.join(distinct_keys(ids, "proof_id"), "proof_id", "left_semi")
    registry = registry.filter(F.col("proof_id").isNotNull())
    order = [F.col("source_priority"), F.col("tie"), F.col("subject_name"), F.xxhash64("proofToken")]
    return first_per_key(registry, ["proof_id", spread("proof_id")], order).drop("source_priority", "tie")


def resolve_permalinks(links: DataFrame, registry: DataFrame) -> DataFrame:
    """links(token_id, parent, w): the score and label each link shows.

    A link with a parent shows the parent's score under the link's weights; one without shows the
    token as stored. Links to unknown tokens are dropped, as a page would not be found.
    """
    links = links.withColumn("proof_id", F.coalesce("parent", "token_id")).withColumn("_w", decode_weights("w"))
    # Only the score and label take part, so whole tokens need not be shuffled to pick one per id.
    shown = F.col("proofToken")["finding"]
    slim = registry.select(
        "proof_id", "source_priority", "tie", "subject_name", shown["score"].alias("base_score"), shown["scoreLabel"].alias("base_label")
    )
    order = [F.col(c) for c in ("source_priority", "tie", "subject_name", "base_score", "base_label")]
    tokens = first_per_key(slim, ["proof_id", spread("proof_id")], order)
    chained = F.col("parent").isNotNull()
    new_score = rescore("base_score", "_w")
    return links.join(tokens, "proof_id").select(
        "token_id",
        "proof_id",
        "subject_name",
        chained.alias("is_chained"),
        encode_weights("_w").alias("weights_code"),
        F.when(chained, new_score).otherwise(F.col("base_score")).alias("score"),
        F.when(chained, score_label(new_score)).otherwise(F.col("base_label")).alias("label"),
    )


def evidence_source_audit(tokens: DataFrame, known_tables: DataFrame, token: str = "proofToken") -> DataFrame:
    """Evidence rows that point at a table nobody registered. known_tables has a column source."""
    rows = tokens.select(F.col(token)["proofId"].alias("proof_id"), F.explode(F.col(token)["evidence"]).alias("e"))
    flat = rows.select("proof_id", F.col("e.source").alias("source"), F.col("e.row_id").alias("row_id"), F.col("e.field").alias("field"))
    return flat.join(distinct_keys(known_tables, "source"), "source", "left_anti")
