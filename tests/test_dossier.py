"""Dossiers, seeds and postal look-ups on small fixtures."""

import random
import re
from datetime import date
from decimal import Decimal as D

import pytest

from grantlens.operators import dossier
from grantlens.session import Stages

ENTITY = "id string, canonical_name string, bn_root string, dataset_sources array<string>, addresses array<struct<postal_code:string>>, fed_profile string, ab_profile string"
GRANT = (
    "_id bigint, ref_number string, amendment_number string, recipient_business_number string, recipient_legal_name string,"
    " recipient_country string, recipient_province string, agreement_value decimal(18,2), agreement_start_date date,"
    " agreement_end_date date, description_en string, prog_name_en string, owner_org_title string"
)


def grant(i, ref, amendment, bn, name, value, org="O"):
    return (i, ref, amendment, bn, name, "CA", None, value, date(2020, 1, i), date(2021, 1, i), None, "P", org)


@pytest.fixture(scope="module")
def data(spark):
    entities = spark.createDataFrame(
        [
            ("e1", "Alpha_Org", "b1", ["fed"], [("k1a 0a6",)], '{"total_grants": 5}', '{"total_grants": "n/a", "total_contracts": 2.5}'),
            ("e2", "Beta", None, None, [("K1A0A6",), ("k1a0a6",), (None,)], None, None),
            ("e3", "Gamma", "b9", None, None, '{"total_grants": 7}', "not json"),
        ],
        ENTITY,
    )
    grants = spark.createDataFrame(
        [
            grant(1, "r1", "1", "b1", "Alpha_Org", D(10)), grant(2, "r1", "2", "b1", "Alpha_Org", D(20), "Q"),
            grant(3, "r2", "", "b1", "x", None), grant(4, "r3", "", None, "BETA", D(5)), grant(5, "r4", "", "b7", "Beta", D(6)),
            grant(6, "r1", "3", None, "Alpha_Org", D(99)),
        ],
        GRANT,
    )
    violations = spark.createDataFrame([("b1",), ("b1",), ("b7",)], "bn string")
    loops = spark.createDataFrame(
        [("b1", f"n{k}", k if k else None, 1, D(1), D(2)) for k in range(7)],
        "bn string, legal_name string, score int, total_loops int, max_bottleneck decimal(18,2), total_circular_amt decimal(18,2)",
    )
    return entities, grants, violations, loops


def test_dossier(spark, data):
    rows = {r.entity_id: r for r in dossier.nest_dossiers(dossier.entity_dossier(*data)).collect()}
    assert set(rows) == {"e1", "e2"}
    one = rows["e1"]
    assert [a._id for a in one.agreements] == [2, 3]
    assert one.fed_summary.total_current_commitment == D("20.00") and one.fed_summary.agreement_count == 1
    assert one.fed_summary.departments == ["Q"] and one.fed_summary.provinces == []
    assert one.violations.arithmetic_violations == 2
    assert [lp.score for lp in one.loops] == [6, 5, 4, 3, 2]
    # without a number only the name counts, and then in any case
    assert [a._id for a in rows["e2"].agreements] == [4, 5] and rows["e2"].violations is None and rows["e2"].loops == []
    kept = {r.entity_id: r for r in dossier.nest_dossiers(dossier.entity_dossier(*data, keep_empty=True)).collect()}
    assert kept["e3"].agreements == [] and kept["e3"].fed_summary is None and kept["e3"].pages == 0
    assert kept["e2"].fed_summary.agreement_count == 2


def test_large_entities_come_in_pages(spark, data):
    entities, grants, violations, loops = data
    many = spark.range(1, 301).selectExpr("id AS _id", "concat('r', id) AS ref_number")
    for name in grants.columns[2:]:
        many = many.crossJoin(grants.limit(1).select(name))
    heads, pages = dossier.entity_dossier(entities, many, violations, loops, page_rows=50)
    assert [(r.pages, r.fed_summary.agreement_count, len(r.loops)) for r in heads.collect()] == [(6, 300, 5)]
    assert pages.columns == ["entity_id", "page", "agreements"] and pages.count() == 6
    assert sorted(a._id for r in pages.collect() for a in r.agreements) == list(range(1, 301))
    assert dossier.nest_dossiers(dossier.Dossiers(heads, pages)).count() == 6


def test_values_come_in_pages_and_heads_stay_small(spark):
    """5,000 programs of one entity: exact pages, a head without lists, a count within five standard errors."""
    rows = spark.range(20_000).selectExpr(
        "'e' AS entity_id", "cast(IF(id = 7, NULL, 1) AS decimal(18,2)) AS agreement_value", "date'2024-01-01' AS agreement_start_date", "date'2024-01-01' AS agreement_end_date",
        "IF(id = 7, 'unvalued', concat('d', id % 3)) AS owner_org_title", "concat('p', id % 5000) AS prog_name_en", "'CA' AS recipient_country", "cast(NULL AS string) AS recipient_province")
    pages = dossier.value_pages(rows, page_values=100).collect()
    listed = {}
    for r in pages:
        assert r["values"] == sorted(r["values"])
        listed.setdefault(r["list"], []).extend(r["values"])
    assert {k: len(v) for k, v in listed.items()} == {"departments": 3, "programs": 5000, "countries": 1}
    assert set(listed["programs"]) == {f"p{k}" for k in range(5000)} and max(len(r["values"]) for r in pages) < 200
    summary = dossier.fed_summary(rows, lists=False).first().fed_summary
    assert (summary.departments, summary.countries, summary.provinces) == (3, 1, 0)
    assert abs(summary.programs - 5000) < 5 * 5000 * 1.04 / 64
    assert dossier.value_pages(rows.limit(0)).count() == 0


def test_names_are_posted_as_ids_and_parts(spark):
    """Names leave the posting list as hash and part, and whole rows take part in the last joins only."""
    df = spark.createDataFrame([(k, f"Name {k % 40}", "x" * 50) for k in range(400)], "id int, name string, wide string")
    seeds = spark.createDataFrame([("name 1", None), ("E 39", "7")], "name string, bn string")
    with dossier.Stages(spark) as stages:
        seen = []
        add = stages.add
        stages.add = lambda made: seen.append(made._jdf.queryExecution().optimizedPlan().toString()) or add(made)
        got = dossier.match_seeds(df, seeds, "name", stages=stages)
        assert got.count() == 11 * 10 + 10
    exploded = [line for plan in seen for line in plan.splitlines() if "Generate explode" in line]
    assert not any("wide" in line for line in exploded)
    assert any(re.search(r"\[[\d, ]+\], false, \[part#", line) for line in exploded)  # the name itself goes no further


def test_seeds(spark, data):
    entities, grants, violations, loops = data
    seeds = spark.createDataFrame([("alpha", "b7"), ("nobody", None), (None, "b1")], "name string, bn string")
    parts = dossier.seed_dossiers(seeds, entities, grants, violations, loops)
    assert [r.id for r in parts["golden"].collect()] == ["e1"]
    assert [r._id for r in parts["agreements"].orderBy("position").collect()] == [6, 2, 5]
    assert [(r.bn, r.arithmetic_violations) for r in parts["violations"].collect()] == [("b1", 2)]
    assert [r.score for r in parts["loops"].orderBy("position").collect()] == [6, 5, 4, 3, 2]
    nested = {r.seed: r for r in dossier.nest_seed_dossiers(seeds, parts).collect()}
    assert nested["nobody"].golden == [] and len(nested["alpha"].agreements) == 3


def test_keyed_documents(spark, data, tmp_path):
    from grantlens.sources import documents

    entities, grants, violations, loops = data
    seeds = spark.createDataFrame([("alpha", "b7"), ("nobody", None)], "name string, bn string")
    nested = dossier.nest_seed_dossiers(seeds, dossier.seed_dossiers(seeds, entities, grants, violations, loops))
    documents.write_keyed_dossiers(nested, str(tmp_path / "d"), "2024-01-01")
    back = {r.slug: r for r in spark.read.json(str(tmp_path / "d")).collect()}
    assert set(back) == {"alpha", "nobody"} and len(back["alpha"].agreements) == 3 and back["alpha"].cachedAt == "2024-01-01"


@pytest.mark.parametrize("count", [1, 1500])
def test_seed_names_are_matched_as_like_does(spark, count):
    rng = random.Random(count)
    word = lambda n: "".join(rng.choice("abAB_ ") for _ in range(n))
    names = [word(rng.randrange(1, 9)) for _ in range(60)] + [None, "", "%"]
    seeds = [(s, None if rng.random() < 0.7 else str(rng.randrange(70))) for s in {word(rng.randrange(6)) for _ in range(count)} | {"%", "a%b", "_", ""}]
    df = spark.createDataFrame([(k, n, str(k)) for k, n in enumerate(names)], "k int, name string, bn string")
    table = spark.createDataFrame(seeds, "name string, bn string")

    def like(name, seed):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in seed.lower())
        return name is not None and re.search(pattern, name.lower(), re.S) is not None

    want = sorted((k, s) for k, n in enumerate(names) for s, _ in seeds if like(n, s))
    assert sorted((r.k, r.seed) for r in dossier.match_seeds(df, table, "name").collect()) == want
    either = sorted((k, s) for k, n in enumerate(names) for s, b in seeds if like(n, s) or b == str(k))
    assert sorted((r.k, r.seed) for r in dossier.match_seeds(df, table, "name", "bn").collect()) == either


def test_postal(spark, data):
    entities = data[0]
    rows = dossier.postal_lookup(entities, "K1A 0A6").collect()
    assert [(r.id, r.total_external_funding) for r in rows] == [("e1", D("7.50")), ("e2", D("0.00"))]
    everywhere = dossier.postal_rollup(entities).orderBy("position").collect()
    assert [(r.postal_code, r.id) for r in everywhere] == [("K1A0A6", "e1"), ("K1A0A6", "e2")]


def test_a_seed_meets_few_names_however_many_there_are(spark):
    """Numbered names share their three-letter parts; each seed must meet the names that hold most of it alone."""
    names = spark.range(3000).selectExpr("concat('customer#', lpad(cast(id AS string), 9, '0')) AS name").selectExpr("name", "xxhash64(name) AS h")
    seeds = names.selectExpr("upper(name) AS name", "CAST(NULL AS string) AS bn")
    with Stages(spark) as stages:
        assert dossier._near(names, seeds, stages).count() == 3000
        assert dossier.name_matches(names.select("name"), seeds, stages).count() == 3000


def test_seeds_of_one_name_and_many_numbers_count_each(spark):
    entities = spark.createDataFrame([(f"E{k}", "Alpha", f"b{k}") for k in range(4)] + [("F", "Beta", "b9")], "id string, canonical_name string, bn_root string")
    grants = spark.createDataFrame(
        [(1, "r1", None, "b1", "Alpha", 5), (2, "r2", None, "b9", None, 7), (3, "r3", None, "b8", "Gamma", 9)],
        "_id long, ref_number string, amendment_number string, recipient_business_number string, recipient_legal_name string, agreement_value int")
    violations = spark.createDataFrame([("b1",), ("b1",)], "bn string")
    loops = spark.createDataFrame([("b1", "Alpha", 3, 1, 0.0, 0.0), ("b2", "Alpha", 4, 1, 0.0, 0.0)],
                                  "bn string, legal_name string, score int, total_loops int, max_bottleneck double, total_circular_amt double")
    seeds = spark.createDataFrame([("alpha", f"b{k}") for k in range(1, 300) if k != 8], "name string, bn string")
    parts = dossier.seed_dossiers(seeds, entities, grants, violations, loops)
    assert [r.id for r in parts["golden"].orderBy("position").collect()] == ["E0"] * 5
    assert [r.bn for r in parts["loops"].orderBy("position").collect()] == ["b2"] * 5
    assert [r._id for r in parts["agreements"].orderBy("position").collect()] == [2, 1]
    assert [(r.bn, r.arithmetic_violations) for r in parts["violations"].collect()] == [("b1", 2 * 298)]
    numbered = dossier.seed_dossiers(seeds.filter("bn = 'b9'"), entities, grants, violations, loops)["golden"]
    assert [r.id for r in numbered.orderBy("position").collect()] == ["E0", "E1", "E2", "E3", "F"]
