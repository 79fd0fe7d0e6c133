"""Column functions on literals."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from grantlens.functions import provenance as fp
from grantlens.functions import scalar, text


def one(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


def many(spark, fn, values, schema="x string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {schema}")
    return [r.out for r in df.select("k", fn("x").alias("out")).orderBy("k").collect()]


def test_blank_to_int(spark):
    assert many(spark, scalar.blank_to_int, ["", "10", " 2 ", None, "x"]) == [None, 10, 2, None, None]


def test_integer_quotient_floors(spark):
    assert many(spark, lambda c: scalar.int_quotient(c, 4), [23, 3, None], "x int") == [5, 0, None]


def test_step_score_and_labels(spark):
    steps = ((100, 6), (10, 4), (1, 2))
    assert many(spark, lambda c: scalar.step_score(c, steps), [101, 100, 10, 2, 1, None], "x int") == [6, 4, 2, 2, 0, 0]
    assert many(spark, scalar.score_label, [22, 21, 14, 13, 7, 6], "x int") == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_capped_sum_ignores_nothing_but_the_cap(spark):
    assert one(spark, scalar.capped_sum([F.lit(20), F.lit(11)])) == 30


def test_fiscal_years(spark):
    days = [date(2024, 3, 31), date(2024, 4, 1), date(2024, 1, 15)]
    assert many(spark, scalar.fiscal_year, days, "x date") == [2024, 2025, 2024]
    assert many(spark, lambda c: scalar.fiscal_year(c, "as_coded"), days, "x date") == [2025, 2025, 2025]
    with pytest.raises(ValueError):
        scalar.fiscal_year("x", "other")


def test_names_and_numbers(spark):
    assert many(spark, scalar.slugify, ["Fish & Chips, Inc.", "--A--", "É b"]) == ["fish-and-chips-inc", "a", "b"]
    assert many(spark, scalar.normalize_name, ["A.B-c 1", "É"]) == ["abc1", ""]
    assert many(spark, scalar.bn_root, ["123456789RR0001", "12345", None]) == ["123456789", None, None]
    assert many(spark, scalar.normalize_postal, ["k1a 0a6", "K1A0A6"]) == ["K1A0A6", "K1A0A6"]


def test_hosts(spark):
    urls = ["https://www.Example.org/a", "http://sub.example.org:80/x?y=1", "not a url", None]
    assert many(spark, scalar.host_of, urls) == ["example.org", "sub.example.org", "not a url", None]


def test_currency_rounds_halves_away_from_zero(spark):
    values = [D("0.5"), D("2.5"), D("1234567.49"), D("-1999.5")]
    assert many(spark, scalar.whole_dollars, values, "x decimal(28,6)") == ["$1", "$3", "$1,234,567", "-$2,000"]


def test_format_value(spark):
    df = spark.createDataFrame(
        [(1, D("1000"), None), (2, D("12.5"), None), (3, D("100"), None), (4, None, "text"), (5, None, None)],
        "k int, n decimal(28,6), t string",
    )
    got = [r.v for r in df.select("k", scalar.format_value("n", "t").alias("v")).orderBy("k").collect()]
    assert got == ["$1,000", "12.5", "100", "text", "(null)"]


def test_index_tag(spark):
    df = spark.createDataFrame([(D("1500"), ["A", "B"]), (D("0"), [])], "t decimal(18,2), d array<string>")
    assert {r.v for r in df.select(scalar.index_tag("t", "d").alias("v")).collect()} == {"$1,500 · A", "$0 · Cross-departmental"}


def test_ranges_include_their_ends(spark):
    df = spark.createDataFrame(
        [(1, D("50.00"), D("100.00")), (2, D("150.00"), D("100.00")), (3, D("150.01"), D("100.00")), (4, None, D("1.00"))],
        "k int, v decimal(18,2), r decimal(18,2)",
    )
    assert [r.k for r in df.filter(scalar.within_pct("v", "r")).orderBy("k").collect()] == [1, 2]
    days = spark.createDataFrame([(1, date(2015, 12, 31), date(2020, 1, 1)), (2, date(2014, 12, 31), date(2020, 1, 1))], "k int, a date, b date")
    assert [r.k for r in days.filter(scalar.within_years("a", "b")).collect()] == [1]


def test_addresses(spark):
    df = spark.createDataFrame([(1, [("k1a 0a6",)]), (2, [(None,)]), (3, None)], "k int, a array<struct<postal_code:string>>")
    assert [r.k for r in df.filter(scalar.any_address_in("a", F.lit("K1A0A6"))).collect()] == [1]


def test_impact_levels(spark):
    golden = [(3, 54, True), (3, 58, True), (3, 49, False), (2, 36, True), (4, 71, False), (4, 73, False), (2, 31, True), (2, 34, True), (1, 22, True), (2, 33, True)]
    df = spark.createDataFrame(golden, "l int, m int, want boolean")
    assert df.filter(scalar.mitigation_passed("l", "m") != F.col("want")).count() == 0


def test_uri_component(spark):
    values = ["a b+c/é", "it's (ok)!*~"]
    assert many(spark, scalar.uri_encode, values) == ["a%20b%2Bc%2F%C3%A9", "it's%20(ok)!*~"]
    assert many(spark, scalar.uri_decode, ["a%20b+c", "%zz"]) == ["a b+c", None]


def test_times(spark):
    t = [datetime(2026, 4, 29, 0, 0, 0, 120000)]
    assert many(spark, scalar.iso_millis, t, "x timestamp") == ["2026-04-29T00:00:00.120Z"]
    assert many(spark, scalar.utc_text, t, "x timestamp") == ["Wed, 29 Apr 2026 00:00:00 GMT"]
    assert many(spark, lambda c: scalar.date_prefix(c, 4), ["2026-04-29"]) == ["2026"]


def test_entity_kind_and_stratum(spark):
    df = spark.createDataFrame(
        [(1, "AIA one", ["fed"]), (2, "X Shipping", ["fed"]), (3, "X", ["ab"]), (4, "X", ["cra"]), (5, "X", ["cra", "fed"])],
        "k int, n string, c array<string>",
    )
    got = [tuple(r) for r in df.select("k", scalar.entity_kind("n", "c"), scalar.stratum("n", F.lit("custom"))).orderBy("k").collect()]
    assert [g[1] for g in got] == ["aia_system", "contract", "ab_grant", "charity", "fed_grant"]
    assert [g[2] for g in got] == ["S3", "S4", "S4", "S4", "S4"]


# --- text -------------------------------------------------------------------------------------


def test_quotes_in_search_order(spark):
    t = 'a "s1" and “c1” then ‘e1’, "s2" and “open'
    assert one(spark, text.direct_quotes("x"), row=(t,)) == ["c1", "s1", "s2", "e1"]


def test_word_count_splits_on_any_space(spark):
    assert many(spark, text.word_count, ["a b c\n d", "", "  "]) == [4, 0, 0]


def test_replace_first_word(spark):
    got = one(spark, text.replace_first_word("x", "c++ (b)", "$1"), row=("see C++ (b)x, c++ (b) c",))
    assert got == "see $1x, c++ (b) c"
    assert one(spark, text.replace_first_word("x", "the", "a"), row=("Other The the",)) == "Other a the"


# --- provenance -------------------------------------------------------------------------------


def test_poly31(spark):
    assert many(spark, fp.poly31_hex, ["ppm-é—x", ""]) == ["e9f4762d", "00000000"]


def test_poly31_uses_utf16_units(spark):
    def reference(s):
        h = 0
        raw = s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k:k + 2], "big")) % 2**32
        return f"{h:08x}"

    values = ["😀 mixed ż", "x" * 300]
    assert many(spark, fp.poly31_hex, values) == [reference(v) for v in values]


def test_weight_codec(spark):
    codes = ["fc:8,cl:5,tv:7,dc:6", "fc:99", "zz:1", "", None, "fc:1,fc:2", "fc:5d", "fc:-3", "fc:,cl", "fc:2.5,dc:NaN,tv:1e1", "fc: 7 "]
    got = many(spark, lambda c: fp.encode_weights(fp.decode_weights(c)), codes)
    assert got == [
        "fc:8,cl:5,tv:7,dc:6", "fc:10,cl:5,tv:4,dc:3", "fc:6,cl:5,tv:4,dc:3", "fc:6,cl:5,tv:4,dc:3", "fc:6,cl:5,tv:4,dc:3",
        "fc:2,cl:5,tv:4,dc:3", "fc:6,cl:5,tv:4,dc:3", "fc:0,cl:5,tv:4,dc:3", "fc:0,cl:5,tv:4,dc:3", "fc:3,cl:5,tv:10,dc:3", "fc:7,cl:5,tv:4,dc:3",
    ]


def test_rescore(spark):
    default = fp.weights_struct(fp.DEFAULT_WEIGHTS)
    zero = fp.weights_struct(dict.fromkeys(fp.DEFAULT_WEIGHTS, 0))
    ten = fp.weights_struct(dict.fromkeys(fp.DEFAULT_WEIGHTS, 10))
    df = spark.range(31).select(F.col("id").cast("int").alias("s"))
    rows = df.select("s", fp.rescore("s", default).alias("d"), fp.rescore("s", zero).alias("z"), fp.rescore("s", ten).alias("t")).collect()
    assert all(r.d == r.s and r.z == 0 for r in rows)
    assert [r.s for r in rows if r.t == 30][0] == 14


def test_summary_note(spark):
    note = " — re-scored under adjusted weights, sensitivity reason logged."
    assert many(spark, fp.rescored_summary, ["Ends here. ", "No end", "Two.."]) == ["Ends here" + note, "No end" + note, "Two." + note]
