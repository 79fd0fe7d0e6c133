"""Briefs and findings: validation, index, search, sort, look-up, statistics, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (
    entity_kind,
    first_numeric_evidence,
    host_of,
    index_tag,
    js_trim,
    mitigation_passed,
    normalize_name,
    slugify,
    stratum,
)
from .skew import distinct_keys
from .text_checks import brief_sentences, citation_violations, phrase_violations, present, quote_violations
from .tokens import token_violations


def brief_text() -> Column:
    """Summary, sentences, unverifiable claims and pull quote, joined by blank lines."""
    sentences = F.transform(brief_sentences(), lambda s: s["text"])
    claims = F.transform(present(F.col("unverifiable")), lambda u: F.concat_ws(" ", u["claim"], u["rationale"]))
    parts = F.concat(
        F.array(F.col("proofToken")["finding"]["summary"]),
        sentences,
        claims,
        F.array(F.coalesce(F.col("pullQuote")["text"], F.lit(""))),
    )
    return F.array_join(parts, "\n\n")


def brief_violations() -> Column:
    return F.concat(citation_violations(), phrase_violations("_text"), quote_violations(), token_violations())


def validate_briefs(briefs: DataFrame, id_cols: Sequence[str] = ("briefId",)) -> DataFrame:
    """All violations of each brief as an array, their number, and the verdict. No shuffle.

    A list that a brief leaves out is empty, so what it does hold is checked all the same and the
    verdict is never NULL.
    """
    checked = briefs.withColumn("_text", brief_text()).select(*id_cols, brief_violations().alias("violations"))
    return checked.withColumn("violation_count", F.size("violations")).withColumn("passed", F.col("violation_count") == 0)


def explode_violations(report: DataFrame, id_cols: Sequence[str] = ("briefId",)) -> DataFrame:
    return report.select(*id_cols, F.inline("violations"))


def brief_stats(briefs: DataFrame) -> DataFrame:
    return briefs.select("briefId", F.size(present(F.col("sources"))).alias("source_count"), F.size(brief_sentences()).alias("sentence_count"))


def enrich_citations(briefs: DataFrame) -> DataFrame:
    """Every citation with what its source says: title, year, kind, authority tier, host; NULLs if unresolved."""
    def lookup(c: Column) -> Column:
        return F.get(F.filter(present(F.col("sources")), lambda s: s["id"] == c), F.lit(0))

    cited = F.flatten(
        F.transform(
            brief_sentences(),
            lambda s: F.transform(
                s["citations"],
                lambda c, i: F.struct(s["text"].alias("sentence"), (i + 1).alias("citation_no"), c.alias("citation"), lookup(c).alias("s")),
            ),
        )
    )
    rows = briefs.select("briefId", F.inline(cited))
    return rows.select(
        "briefId", "sentence", "citation_no", "citation", F.col("s.title").alias("title"), F.col("s.kind").alias("kind"),
        F.col("s.year").alias("year"), F.col("s.authorityTier").alias("authority_tier"), host_of("s.url").alias("host"),
        F.col("s.retrievalDate").alias("retrieval_date"),
    )


def brief_index(briefs: DataFrame, brief_type: str) -> DataFrame:
    """slug, title, tag of the briefs of a type, in title order by locale."""
    return (
        briefs.filter(F.col("briefType") == brief_type)
        .select(
            "slug",
            F.col("subject")["canonicalName"].alias("title"),
            index_tag(F.col("governmentRecords")["totalAgreementValue"], F.col("governmentRecords")["awardingDepartments"]).alias("tag"),
            F.col("briefType").alias("brief_type"),
        )
        .orderBy(F.collate("title", "UNICODE"), "slug")
    )


def briefs_by_name(briefs: DataFrame, names: DataFrame) -> DataFrame:
    """names(name): briefs whose subject has the same name but for case and punctuation."""
    keyed = briefs.withColumn("name_key", normalize_name(F.col("subject")["canonicalName"]))
    wanted = names.select("name", normalize_name("name").alias("name_key"))
    return wanted.join(keyed, "name_key")


# --- finding cards ----------------------------------------------------------------------------


def _finding() -> Column:
    return F.col("proofToken")["finding"]


def search_findings(findings: DataFrame, query: str = "") -> DataFrame:
    """Cards whose name, summary or number contains the query, any case; an empty query keeps all."""
    needle = F.lower(js_trim(F.lit(query)))
    subject = _finding()["subject"]
    haystack = F.concat_ws(
        " ", F.coalesce(subject["canonicalName"], F.lit("")), F.coalesce(_finding()["summary"], F.lit("")), F.coalesce(subject["bnRoot"], F.lit(""))
    )
    return findings.filter(F.lower(haystack).contains(needle))


def sort_findings(findings: DataFrame, by: str = "score", tie: str | None = None) -> DataFrame:
    """Order by 'score' or 'indicators' (highest first) or 'name' (by locale); ties by the given column."""
    last = [F.col(tie)] if tie else [F.col("proofToken")["proofId"]]
    keys = {
        "score": _finding()["score"].desc(),
        "indicators": F.col("indicatorCount").desc(),
        "name": F.collate(_finding()["subject"]["canonicalName"], "UNICODE"),
    }
    return findings.orderBy(keys[by], *last)


def feed(findings: DataFrame, query: str = "", sort_by: str = "score") -> DataFrame:
    return sort_findings(search_findings(findings, query), sort_by)


def finding_by_slug(findings: DataFrame, slugs: DataFrame) -> DataFrame:
    """slugs(slug): the cards with that slug of their subject's name."""
    keyed = findings.withColumn("slug", slugify(_finding()["subject"]["canonicalName"]))
    return keyed.join(distinct_keys(slugs, "slug"), "slug", "left_semi")


def display_facets(findings: DataFrame) -> DataFrame:
    """What a card shows beside its score: entity kind, stratum, and its headline number."""
    subject = _finding()["subject"]
    headline = first_numeric_evidence(F.col("proofToken")["evidence"])
    return findings.select(
        F.col("proofToken")["proofId"].alias("proof_id"),
        entity_kind(subject["canonicalName"], subject["datasetCoverage"]).alias("entity_kind"),
        stratum(subject["canonicalName"], _finding()["type"]).alias("stratum"),
        headline["value_num"].alias("headline_value"),
        headline["source"].alias("headline_source"),
    )


def impact_gate(register: DataFrame, level: str = "impactLevel", mitigation: str = "mitigationScore") -> DataFrame:
    return register.withColumn("mitigation_passed", mitigation_passed(level, mitigation))
