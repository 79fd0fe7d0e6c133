"""Tokens, briefs and document files."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlens.functions import provenance as fp
from grantlens.operators import audits, briefs, tokens
from grantlens.sources import documents, schemas


def make_token(**changes):
    token = {
        "proofId": "ppm-2026-01-01-abc", "version": "1.0", "issuedAt": "2026-01-01T00:00:00.000Z", "issuedBy": "desk",
        "finding": {
            "type": "custom", "summary": "A measured statement.", "score": 12, "scoreScale": "0-30", "scoreLabel": "MEDIUM",
            "subject": {"entityId": "e", "canonicalName": "Alpha & Sons", "bnRoot": None, "datasetCoverage": ["fed"]},
        },
        "evidence": [
            {"source": "fed.grants", "rowId": "g1", "field": "status", "value": "open"},
            {"source": "fed.missing", "rowId": 17, "field": "value", "value": 1234.5, "asOf": "2026-01-01"},
            {"source": "fed.grants", "rowId": "g2", "field": "none", "value": None},
        ],
        "tiers": {
            "input": {"passed": True, "tier": 1, "filtersApplied": ["latest"], "knownDataIssuesRespected": [], "rejected": []},
            "contextual": {"passed": True, "tier": 2, "model": "rules", "promptHash": "h", "promptVersion": "v1", "temperature": 0.5, "tokensIn": 1, "tokensOut": 2},
            "output": {"passed": True, "tier": 3, "calibrationCheck": "passed", "citationCount": 2, "quoteWordCountMax": 9, "uniqueSourcesQuoted": 1, "languageViolations": []},
            "audit": {"passed": True, "tier": 4, "tokenHash": "sha256:x", "previousTokenHash": None, "humanReviewed": False, "humanReviewer": None, "operatorAgent": "desk", "logRef": "log"},
        },
        "disclaimers": ["These are observations from public records."],
        "rerunUrl": "/proof/rerun/ppm-2026-01-01-abc",
    }
    for path, value in changes.items():
        at = token
        *parents, leaf = path.split("__")
        for p in parents:
            at = at[p]
        at[leaf] = value
    return token


def make_brief(**changes):
    brief = {
        "briefId": "b1", "briefType": "outcome",
        "subject": {"entityId": "e", "canonicalName": "Alpha & Sons", "bnRoot": None, "datasetCoverage": ["fed"]},
        "identity": {"canonicalName": "Alpha & Sons", "bnRoot": None, "addresses": [], "datasetCoverage": []},
        "governmentRecords": {"totalAgreementValue": 1500000, "amendmentCount": 1, "dateRangeStart": "2020-01-01", "dateRangeEnd": "2021-01-01",
                              "awardingDepartments": ["Health"], "programCodes": [], "province": "ON"},
        "publicSources": [{"sectionHeading": "h", "sentences": [{"text": "Records show “two words”.", "citations": ["s1"]}]}],
        "unverifiable": [{"claim": "Outcomes", "rationale": "cannot be assessed."}],
        "sources": [{"id": "s1", "kind": "news", "title": "T", "url": "https://www.example.org/x", "year": 2024, "retrievalDate": "2026-01-01", "authorityTier": 1}],
        "proofToken": make_token(),
    }
    brief.update(changes)
    return brief


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("docs")
    (base / "briefs").mkdir()
    leaky = make_brief(briefId="b2", briefType="counterfactual", pullQuote={"text": "It was clearly shown. A scam.", "attribution": "a", "sourceId": "s1"})
    leaky["proofToken"] = make_token(proofId="ppm-other")
    for name, doc in (("alpha", make_brief()), ("beta", leaky)):
        (base / "briefs" / f"{name}.json").write_text(json.dumps(doc, indent=2), encoding="utf8")
    (base / "briefs" / "notes.txt").write_text("not a brief")
    cards = [
        {"primaryJurisdiction": "federal", "lastUpdated": "2026-04-22T00:00:00Z", "indicatorCount": n, "proofToken": make_token(proofId=f"ppm-{n}", finding__score=s)}
        for n, s in ((3, 20), (9, 5), (5, 20))
    ]
    (base / "findings.json").write_text(json.dumps(cards, indent=1))
    register = [{"aiaId": "A", "systemName": "S", "department": "D", "publishedDate": None, "impactLevel": 3, "riskScore": 60, "mitigationScore": 49,
                 "description": "d", "sourceUrl": "u", "sourceJsonUrl": None, "retrievedAt": "2026-04-28T22:00:00Z"}]
    (base / "register.json").write_text(json.dumps(register))
    return base


def token_frame(spark, *docs):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("proofToken", T.DataType.fromDDL(schemas.TOKEN))])
    rows = []
    for k, t in enumerate(docs):
        if t is not None:
            t = dict(t)
            t["evidence"] = []
        rows.append((k, t))
    return spark.createDataFrame(rows, schema)


def test_completeness_rules(spark):
    docs = [
        make_token(), None, make_token(disclaimers=["other"]), make_token(tiers__output__calibrationCheck="failed"),
        make_token(tiers__output__quoteWordCountMax=15), make_token(proofId="tok-1"), make_token(tiers__input__filtersApplied=[]),
        make_token(tiers__contextual__model=None), make_token(tiers__audit__operatorAgent=""), make_token(version=""),
        make_token(tiers__output__citationCount=None), make_token(finding__summary=None, issuedAt=None),
    ]
    got = {}
    for r in tokens.token_completeness(token_frame(spark, *docs), id_cols=["k"]).collect():
        got.setdefault(r.k, []).append((r.type, r.detail))
    assert 0 not in got
    assert got[1] == [("PROOF_INCOMPLETE", "No Proof token attached to the output.")]
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 2}
    assert got[4][0][0] == "QUOTE_TOO_LONG"


def test_seal_covers_all_but_itself(spark):
    df = token_frame(spark, make_token(), make_token(tiers__audit__tokenHash="sha256:y"), make_token(finding__score=13))
    sealed = tokens.seal_tokens(df).select("k", F.col("proofToken.tiers.audit.tokenHash").alias("h")).orderBy("k").collect()
    assert sealed[0].h == sealed[1].h != sealed[2].h
    audit = tokens.chain_audit(tokens.seal_tokens(df)).collect()
    assert all(r.seal_holds for r in audit)


def test_chain(spark):
    df = token_frame(spark, make_token(), make_token(), make_token(), make_token()).withColumn(
        "reason", F.element_at(F.array(F.lit("checked weights"), F.lit("it was a scam"), F.lit(""), F.lit(None)), F.col("k") + 1)
    )
    committed = tokens.chain_tokens(df, issued_at="2026-02-02T00:00:00.000Z", issued_by="reviewer")
    rows = committed.collect()
    assert [r.k for r in rows] == [0]
    child = rows[0].proofToken
    assert child.finding.score == 12 and child.finding.summary.startswith("A measured statement — re-scored")
    assert child.tiers.audit.previousTokenHash == "sha256:x" and child.tiers.audit.tokenHash.endswith("-pending-seal")
    assert child.proofId.startswith("ppm-2026-02-02T00:00:00.000Z-chain-")
    rejected = {r.k: r.proofToken.tiers.output for r in tokens.chain_tokens(df, keep_rejected=True).collect()}
    assert rejected[1].languageViolations == ["chainReason flagged 1 calibration violation(s)"]
    both = df.select("proofToken").unionByName(committed.select("proofToken"))
    links = tokens.parent_links(both).collect()
    assert {r.child_id for r in links} == {child.proofId} and len(links) == 4
    found = {r.proof_id: r.parent_found for r in tokens.chain_audit(both).collect()}
    assert found[child.proofId] is True
    w = fp.weights_struct(fp.DEFAULT_WEIGHTS)
    link = committed.select(tokens.permalink("proofToken.proofId", F.lit("p"), w, "reason").alias("u")).first().u
    assert link.endswith("?parent=p&w=fc:6,cl:5,tv:4,dc:3&reason=checked%20weights")


def test_issue_is_deterministic(spark):
    df = token_frame(spark, make_token(), make_token(finding__summary="Other"), make_token(finding__type="outcome_gap"))
    df = df.select("k", F.col("proofToken.finding").alias("finding"), F.col("proofToken.evidence").alias("evidence"), F.col("proofToken.tiers").alias("tiers"))
    rows = tokens.issue_tokens(df, "2026-01-01", "2026-01-01").orderBy("k").collect()
    ids = [r.proofToken.proofId for r in rows]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("ppm-2026-01-01-") and len(ids[0]) == len("ppm-2026-01-01-") + 6
    assert tokens.token_completeness(tokens.issue_tokens(df, "2026-01-01", "2026-01-01")).count() == 0


def test_read_findings_splits_evidence(spark, folder):
    df = documents.read_findings(spark, str(folder / "findings.json"))
    rows = df.filter("indicatorCount = 3").first().proofToken.evidence
    assert [(e.row_id, e.value_str, None if e.value_num is None else float(e.value_num)) for e in rows] == [
        ("g1", "open", None), ("17", None, 1234.5), ("g2", None, None)
    ]
    order = [r.proofToken.proofId for r in briefs.feed(df, sort_by="score").collect()]
    assert order == ["ppm-3", "ppm-5", "ppm-9"]
    assert [r.indicatorCount for r in briefs.feed(df, sort_by="indicators").collect()] == [9, 5, 3]
    assert briefs.feed(df, " ALPHA & ").count() == 3 and briefs.feed(df, "nowhere").count() == 0
    facts = briefs.display_facets(df).filter("proof_id = 'ppm-3'").first()
    assert float(facts.headline_value) == 1234.5 and facts.headline_source == "fed.missing"
    slugs = spark.createDataFrame([("alpha-and-sons",)], "slug string")
    assert briefs.finding_by_slug(df, slugs).count() == 3
    known = spark.createDataFrame([("fed.grants",)], "source string")
    assert {r.source for r in tokens.evidence_source_audit(df, known).collect()} == {"fed.missing"}


def test_numbers_are_hashed_as_written(spark, tmp_path):
    written = ["0.12345678", "1e23", "-0", "1.50", "1.5", '"1.50"', "null", "123456789012345678901234567890123456789012.25", "1E-30", "true", '"\\\\\\"value\\\\\\": 7"']
    rows = [{"proofToken": {"proofId": f"ppm-{k}", "evidence": [{"source": "s", "rowId": k}, None]}} for k in range(len(written))]
    lines = [json.dumps(r).replace(f'"rowId": {k}', f'"rowId": {k}, "value": {w}') for k, (r, w) in enumerate(zip(rows, written))]
    (tmp_path / "f.json").write_text("\n".join(lines))
    df = documents.read_findings(spark, str(tmp_path / "f.json"), one_per_line=True)
    got = {int(r.proofToken.proofId[4:]): (r.proofToken.evidence[0], r.h) for r in df.withColumn("h", fp.evidence_hash("proofToken.evidence")).collect()}
    assert [got[k][0].value_raw for k in range(len(written))] == [None if w[0] in 'n"' else w for w in written]
    assert got[5][0].value_str == "1.50" and got[0][0].value_num == D("0.1234567800") and got[1][0].value_num == D(10**23)
    assert len({h for _, h in got.values()}) == len(written)  # 1.5, 1.50 and "1.50" are three pieces of evidence
    one = json.loads(df.select(fp.canonical_json("proofToken.evidence").alias("j"), "proofToken.proofId").filter("proofId = 'ppm-7'").first().j)
    assert one[0]["value_raw"] == written[7] and one[0]["value_num"] is None


def test_read_and_validate_briefs(spark, folder):
    df = documents.read_briefs(spark, str(folder / "briefs"))
    assert {r.slug for r in df.collect()} == {"alpha", "beta"}
    report = {r.briefId: r for r in briefs.validate_briefs(df).collect()}
    assert report["b1"].passed and report["b1"].violations == []
    assert [v.match for v in report["b2"].violations] == ["scam"] and not report["b2"].passed
    assert briefs.explode_violations(briefs.validate_briefs(df)).count() == 1
    assert [tuple(r) for r in briefs.brief_index(df, "outcome").collect()] == [("alpha", "Alpha & Sons", "$1,500,000 · Health", "outcome")]
    cited = briefs.enrich_citations(df).filter("briefId = 'b1'").first()
    assert (cited.citation_no, cited.title, cited.host, cited.authority_tier) == (1, "T", "example.org", 1)
    names = spark.createDataFrame([("ALPHA sons",), ("alpha &sons!",)], "name string")
    assert briefs.briefs_by_name(df, names).count() == 4


def test_registry_prefers_findings(spark, folder):
    cards = documents.read_findings(spark, str(folder / "findings.json"))
    written = documents.read_briefs(spark, str(folder / "briefs"))
    both = cards.withColumn("proofToken", F.col("proofToken").withField("proofId", F.lit("ppm-other")))
    registry = tokens.token_registry(both, written)
    found = {r.proof_id: r.source for r in tokens.find_tokens(registry).collect()}
    assert found == {"ppm-other": "finding", "ppm-2026-01-01-abc": "brief"}
    ids = spark.createDataFrame([("ppm-other",), ("ppm-none",)], "proof_id string")
    assert tokens.find_tokens(registry, ids).count() == 1
    links = spark.createDataFrame(
        [("ppm-other", None, None), ("new", "ppm-2026-01-01-abc", "fc:10,cl:10,tv:10,dc:10"), ("gone", "ppm-none", None)],
        "token_id string, parent string, w string",
    )
    shown = {r.token_id: (r.is_chained, r.score, r.label) for r in tokens.resolve_permalinks(links, registry).collect()}
    assert shown["new"] == (True, 27, "CRITICAL") and shown["ppm-other"][0] is False and "gone" not in shown


def test_register_and_export(spark, folder, tmp_path):
    register = documents.read_register(spark, str(folder / "register.json"))
    assert [r.mitigation_passed for r in briefs.impact_gate(register).collect()] == [False]
    cards = documents.read_findings(spark, str(folder / "findings.json"))
    out = documents.export_tokens(cards, "Issuer", "https://example.org/verify", "note")
    body = json.loads(out.filter("proof_id = 'ppm-3'").first().body)
    assert body["_verifiability"]["verifyAt"] == "https://example.org/verify/ppm-3"
    assert body["tiers"]["audit"]["previousTokenHash"] is None and body["evidence"][1]["value_num"] == 1234.5
    documents.write_exports(out, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 3


def test_verify_lines(spark):
    row = tokens.verify_tokens(token_frame(spark, make_token(tiers__audit__previousTokenHash="h"))).first()
    assert row.passed and row.badge == "sage"
    assert row.output_detail == "2 citations · max-quote 9 words · calibration passed"
    assert row.audit_detail == "Operator desk; chained"


def test_links_and_secrets(spark):
    html = """<a href="/a?x=1">1</a><a href='/b/c#t'>2</a><a href={`/d/${x}`}>3</a><a href="https://x.org/">4</a>
    <a href="#top">5</a><a href="mailto:a@b">6</a><a href="rel">7</a><a href="/docs/a/b">8</a><a href="/b/c/d">9</a><a href="/api/x">10</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.path for r in audits.dead_links(pages, ["/a", "/b/[id]", "/docs/[...rest]"]).collect()] == ["/b/c/d"]
    routes = spark.createDataFrame([("/a",), ("/b/c",)], "path string")
    assert sorted(r.path for r in audits.dead_links_table(pages, routes).collect()) == ["/b/c/d", "/docs/a/b"]
    docs = spark.createDataFrame([(1, 'API-Key = "' + "a1" * 8 + '"'), (2, "secret: short"), (3, "bearer " + "z" * 16)], "doc_id int, text string")
    assert sorted(r.doc_id for r in audits.secret_scan(docs).collect()) == [1, 3]
