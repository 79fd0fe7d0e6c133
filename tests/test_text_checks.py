"""Language rules, citations and quotes."""

import dataclasses
import re

import pytest

from grantlens.operators import briefs as bf
from grantlens.operators import text_checks as tc
from grantlens.streaming.live_checks import sweep_stream

FLAGGED = [
    "The ministry failed to publish the schedule.",
    "There is proof of fraud in the ledger.",
    "The form ought to have listed the goals.",
    "Gifts were made in return for contracts.",
    "Meetings rose because of the new grant round.",
    "That meeting resulted in a larger contract.",
    "This raises serious questions on control.",
    "The charity reportedly moved the money.",
    "The review clearly shows neglect.",
    "It took massive amounts of public money.",
]
CLEAN = [
    "The dataset shows contributions of $12M over four fiscal years.",
    "Pattern consistent with growth by amendment.",
    "Records indicate that the agreement ended in July.",
    "Comparable filings typically state a program stream.",
    "A registration was filed 30 days before the award.",
    "Score: 20 of 30 indicators.",
    "Public records do not contain a closing report.",
    "Documents reference an audit published in June.",
    "éfrauder, unproven_x and reschemed are other words; becauseof grant too.",
]


def sweep(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return tc.calibration_sweep(df, "text", ["k"], **kw).collect()


def test_flags_and_accepts(spark):
    hit = {r.k for r in sweep(spark, FLAGGED + CLEAN)}
    assert hit == set(range(len(FLAGGED)))


def test_ascii_word_boundaries(spark):
    # an accented letter is no word character for the rules
    assert [r.match for r in sweep(spark, ["éfraud"])] == ["fraud"]


def test_sentence_around_a_hit(spark):
    long_tail = "x" * 200
    rows = sweep(spark, ["One. Two was a scam here. Three.", "Start. Scam " + long_tail, "scam"])
    got = {r.k: (r.match, r.sentence) for r in rows}
    assert got[0] == ("scam", "Two was a scam here.")
    assert got[1] == ("Scam", "Scam " + "x" * 95)
    assert got[2] == ("scam", "scam")


def test_only_first_match_per_rule_unless_per_sentence(spark):
    text = ["A fraud. Another crime. They knowingly did."]
    assert sorted(r.match for r in sweep(spark, text)) == ["fraud", "knowingly"]
    assert sorted(r.match for r in sweep(spark, text, per_sentence=True)) == ["crime", "fraud", "knowingly"]


BRIEF_PARTS = {
    "publicSources": [("h", [("It was a fraud.", ["a"]), ("Says “one two”.", None)], None), ("empty", None, None)],
    "sources": [("a", "news", "A", "https://a", 2020, "2020-01-01", 1)],
    "unverifiable": [("This was a scam", "none")],
}


@pytest.mark.parametrize("absent", [(), ("publicSources",), ("sources",), ("unverifiable",), ("publicSources", "unverifiable"), tuple(BRIEF_PARTS)])
def test_a_brief_that_leaves_lists_out_is_judged_by_the_rest(spark, absent):
    from grantlens.sources import schemas

    schema = schemas.as_schema(schemas.brief())
    row = {"briefId": "b"} | {k: v for k, v in BRIEF_PARTS.items() if k not in absent}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema)
    got = bf.validate_briefs(df).first()
    assert got.passed is False  # without a token at least
    kinds = [(v.type, v.match or v.detail) for v in got.violations]
    assert (("CALIBRATION_LEAK", "fraud") in kinds) == ("publicSources" not in absent)
    assert (("CALIBRATION_LEAK", "scam") in kinds) == ("unverifiable" not in absent)
    bare = sum(k == ("MISSING_CITATION", tc.NO_CITATION) for k in kinds)
    loose = sum(k == ("MISSING_CITATION", tc.UNRESOLVED_CITATION.format("a")) for k in kinds)
    assert bare == ("publicSources" not in absent)
    assert loose == ("publicSources" not in absent and "sources" in absent)
    assert bf.enrich_citations(df).count() == ("publicSources" not in absent)
    assert bf.brief_stats(df).first().sentence_count == (0 if "publicSources" in absent else 2)


SENTENCES = "briefId string, publicSources array<struct<sectionHeading:string,sentences:array<struct<text:string,citations:array<string>>>>>, sources array<struct<id:string>>"
BRIEF = (
    "b", [("h", [
        ("Says “one two”.", ["a", "z"]),
        ("Plain.", []),
        ('Again "three" and ‘four’.', ["a", "b"]),
    ]), ("h2", [("“" + "w " * 16 + "”", ["z", "z"])])],
    [("a",), ("b",)],
)


def test_citations(spark):
    rows = tc.citation_completeness(spark.createDataFrame([BRIEF], SENTENCES)).collect()
    assert sorted(r.detail for r in rows) == [
        "Citation z does not resolve to a source in this brief.", "Citation z does not resolve to a source in this brief.",
        "Citation z does not resolve to a source in this brief.", "No citation pointer on a prose sentence.",
    ]


def test_quotes(spark):
    rows = tc.quote_discipline(spark.createDataFrame([BRIEF], SENTENCES)).collect()
    assert [r.detail for r in rows if r.type == "QUOTE_TOO_LONG"] == ["Direct quote is 16 words; the ceiling is 15."]
    # a: 1st use in sentence 0, then 'three' and 'four'; b: 'four'; z: used in sentence 0, then twice
    reused = sorted(r.detail.split()[1] for r in rows if r.type == "QUOTE_REUSED")
    assert reused == ["a", "a", "b", "z", "z"]


def test_sentence_table_agrees_with_nested_form(spark):
    nested = spark.createDataFrame([BRIEF], SENTENCES)
    rows = [("b", n, t, c) for n, (t, c) in enumerate(s for _, sec in BRIEF[1] for s in sec)]
    table = spark.createDataFrame(rows, "brief_id string, sentence_no int, text string, citations array<string>")
    sources = spark.createDataFrame([("b", "a"), ("b", "b"), ("b", "b")], "brief_id string, source_id string")
    key = lambda r: (r.type, r.sentence, getattr(r, "match", ""), r.detail)
    assert sorted(map(key, tc.quote_discipline(nested).collect())) == sorted(map(key, tc.quote_discipline_table(table).collect()))
    a = sorted((r.sentence, r.detail) for r in tc.citation_completeness(nested).collect())
    assert a == sorted((r.sentence, r.detail) for r in tc.citation_completeness_table(table, sources).collect())


def test_stream_and_table_agree(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(FLAGGED + CLEAN)), "k int, text string")
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, text string").json(str(tmp_path / "in"))
    query = sweep_stream(stream, "text", ["k"], str(tmp_path / "c"), sink="memory").queryName("swept").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.k, r.match) for r in tc.calibration_sweep(df, "text", ["k"]).collect()}
    assert {(r.k, r.match) for r in spark.table("swept").collect()} == want
    with pytest.raises(ValueError):
        sweep_stream(df, "text", ["k"], str(tmp_path / "c2"))


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    source, sink, place = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part, texts in enumerate((FLAGGED[:6], FLAGGED[6:])):
        spark.createDataFrame([(10 * part + k, t) for k, t in enumerate(texts)], "k int, text string").write.mode("append").json(source)
        stream = spark.readStream.schema("k int, text string").json(source)
        query = sweep_stream(stream, "text", ["k"], place, path=sink).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(r.k for r in spark.read.parquet(sink).collect())
    assert got == sorted(set(got)) and len(got) == len(FLAGGED)


@pytest.mark.parametrize(("pattern", "hits"), [
    (r"\b(?:foo|bar)\b", ["a foo here", "BAR", "éfoo"]), (r"foo", ["xfoox", "Foo"]), (r"\b(Foo)\b", ["foo.", "the Foo"]), (r"\bFoo", ["food"]),
    (r"oo\b", ["foo"]), (r"(?:^|\s)x", ["x", "a x"]), (r"a\\b", ["a\\b"])])
def test_any_rule_finds_what_its_pattern_finds(spark, pattern, hits):
    rules = (tc.PhraseRule("custom", pattern, "drop"),)
    texts = [*hits, "nothing", "sfoos and rebar", "fraud"]
    want = {t for t in texts if re.search(pattern, t, re.I | re.A)}
    assert set(hits) <= want
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text for r in tc.calibration_sweep(df, "text", ["text"], rules=rules).collect()} == want
    both = tc.calibration_sweep(df, "text", ["text"], rules=(*tc.PHRASE_RULES, *rules)).collect()
    assert {r.text for r in both} == want | {"fraud"}


def test_anchor_words_lose_no_hit(spark):
    """Every rule's own phrases, alone, capitalised, inside other words and beside other alphabets: the same hits with and without its anchors."""
    phrases = [p for r in tc.PHRASE_RULES for p in re.findall(r"[a-z][a-z -]*[a-z]", r.pattern)]
    texts = [f(p) for p in phrases for f in (str, str.upper, "x{}".format, "so {} x".format, "{} grant".format, "é{}.".format, "İ{}İ\u0307".format, "K\n{}\u2028s".format)] + FLAGGED + CLEAN
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = tuple(dataclasses.replace(r, anchors=()) for r in tc.PHRASE_RULES)
    hits = [sorted((r.text, r.match, r.rewrite) for r in tc.calibration_sweep(df, "text", ["text"], rules=rules).collect()) for rules in (tc.PHRASE_RULES, plain)]
    assert hits[0] == hits[1] and len(hits[0]) > 100


def test_anchors_are_in_every_alternative():
    """Every way through a rule's pattern, optional parts with and without, holds one of its anchors as a whole word."""
    def ways(pattern):
        pattern = pattern.replace("[^.]{0,80}", " x ").replace("\\b", "").replace("(?:", "(").replace("[- ]", "( |-)")
        pattern = re.sub(r"([a-z])\?", r"(\1|)", pattern)
        pattern = re.sub(r"\(([^()]*)\)\?", r"(\1|)", pattern)
        out = {pattern}
        while any("(" in p for p in out):
            new = set()
            for p in out:
                m = re.search(r"\(([^()]*)\)", p)
                new |= {p[:m.start()] + part + p[m.end():] for part in m[1].split("|")} if m else {p}
            out = new
        return out

    for rule in tc.PHRASE_RULES:
        assert rule.anchors
        for way in ways(rule.pattern):
            assert re.search(rule.pattern, way), way
            assert set(re.findall("[a-z]+", way)) & set(rule.anchors), way


def test_texts_of_one_row_group_are_worked_on_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from grantlens.plans import prose

    swept = prose._swept(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p")).distinct().count()
    assert swept > 1
