"""Scalar column functions: keys, scores, labels, names, dates and display values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Score label thresholds, highest first.
SCORE_LABELS = ((22, "CRITICAL"), (14, "HIGH"), (7, "MEDIUM"))
LOWEST_LABEL = "LOW"

# Mitigation score required at each impact level.
REQUIRED_MITIGATION = {1: 0, 2: 25, 3: 50, 4: 75}

# Whitespace as ECMAScript regular expressions and trim() define it.
SPACE = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, also where lambdas inside the body refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- keys and casts ---------------------------------------------------------------------------


def recipient_partition_key(bn: ColumnLike, name: ColumnLike, row_id: ColumnLike) -> Column:
    """Business number, else legal name, else the row's own id."""
    return F.coalesce(col(bn), col(name), col(row_id).cast("string"))


def blank_to_int(c: ColumnLike) -> Column:
    """Integer held as text; blank and unreadable values become NULL (safe under ANSI mode)."""
    return F.nullif(F.trim(col(c)), F.lit("")).try_cast("int")


def bn_root(c: ColumnLike) -> Column:
    """First nine digits of a business number, NULL when it does not start with nine digits."""
    return F.nullif(F.regexp_extract(col(c), r"^(\d{9})", 1), F.lit(""))


def matching_number(c: ColumnLike, by_root: bool) -> Column:
    """The number that records are matched by: as written, or its root where it has one."""
    return F.coalesce(bn_root(c), col(c)) if by_root else col(c)


def normalize_postal(c: ColumnLike) -> Column:
    return F.replace(F.upper(col(c)), F.lit(" "), F.lit(""))


def normalize_name(c: ColumnLike) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def slugify(c: ColumnLike) -> Column:
    dashed = F.regexp_replace(F.replace(F.lower(col(c)), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def js_trim(c: ColumnLike) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


# --- scores -----------------------------------------------------------------------------------


def step_score(c: ColumnLike, steps: Sequence[tuple[float, int]]) -> Column:
    """Points of the first (threshold, points) step the value exceeds; 0 for none and for NULL."""
    out = None
    for threshold, points in steps:
        test = col(c) > F.lit(threshold)
        out = F.when(test, F.lit(points)) if out is None else out.when(test, F.lit(points))
    return out.otherwise(F.lit(0))


def capped_sum(terms: Sequence[Column], cap: int = 30) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.least(F.lit(cap), total)


def int_quotient(c: ColumnLike, divisor: int) -> Column:
    return F.call_function("div", col(c).cast("bigint"), F.lit(divisor).cast("bigint"))


def score_label(score: ColumnLike) -> Column:
    out = None
    for threshold, label in SCORE_LABELS:
        test = col(score) >= threshold
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(LOWEST_LABEL))


def js_round(c: ColumnLike) -> Column:
    """Round half up, towards positive infinity."""
    return F.floor(col(c) + F.lit(0.5))


# --- predicates -------------------------------------------------------------------------------


def within_pct(c: ColumnLike, reference: ColumnLike, pct: float = 0.5) -> Column:
    """The value lies within +/- pct of the reference, ends included, in exact decimal arithmetic."""
    low = F.lit(f"{1 - pct:g}").cast("decimal(6,4)")
    high = F.lit(f"{1 + pct:g}").cast("decimal(6,4)")
    return col(c).between(col(reference) * low, col(reference) * high)


def has_description(c: ColumnLike, min_len: int = 80) -> Column:
    return col(c).isNotNull() & (F.length(col(c)) > min_len)


def within_years(a: ColumnLike, b: ColumnLike, years: int = 5) -> Column:
    return F.abs(F.year(col(a)) - F.year(col(b))) <= years


# --- dates ------------------------------------------------------------------------------------


def fiscal_year(c: ColumnLike, mode: str = "calendar") -> Column:
    """'calendar': April to March, named by its last year. 'as_coded': calendar year plus one."""
    if mode == "calendar":
        return F.year(F.add_months(col(c).cast("date"), 9))
    if mode == "as_coded":
        return F.year(col(c)) + 1
    raise ValueError(f"unknown fiscal year mode: {mode}")


def iso_millis(ts: ColumnLike) -> Column:
    """Timestamp as ISO text with milliseconds and Z (UTC session time zone)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_text(ts: ColumnLike) -> Column:
    """Timestamp as 'Wed, 29 Apr 2026 00:00:00 GMT' (UTC session time zone)."""
    return F.date_format(col(ts), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def date_prefix(c: ColumnLike, chars: int = 10) -> Column:
    """Leading year (4) or day (10) of an ISO date text."""
    return F.substring(col(c).cast("string"), 1, chars)


# --- links ------------------------------------------------------------------------------------

# Characters a URI component keeps although form encoding escapes them.
URI_UNESCAPED = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def uri_encode(c: ColumnLike) -> Column:
    """Percent-encode a URI component."""
    out = F.url_encode(col(c))
    for form, uri in URI_UNESCAPED:
        out = F.replace(out, F.lit(form), F.lit(uri))
    return out


def uri_decode(c: ColumnLike) -> Column:
    """Decode a URI component; NULL when it is malformed."""
    return F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B")))


# --- nested values ----------------------------------------------------------------------------


def json_number(doc: ColumnLike, key: str) -> Column:
    """Number under a key of a JSON object held as text; NULL when absent or not a number."""
    return F.get_json_object(col(doc), f"$.{key}").try_cast("decimal(38,6)")


def any_address_in(addresses: ColumnLike, postal: ColumnLike) -> Column:
    """Some address of the array has the postal code, both sides normalised."""
    wanted = normalize_postal(postal)
    return F.exists(col(addresses), lambda a: normalize_postal(a["postal_code"]) == wanted)


def first_numeric_evidence(evidence: ColumnLike) -> Column:
    return F.get(F.filter(col(evidence), lambda e: e["value_num"].isNotNull()), F.lit(0))


# --- display ----------------------------------------------------------------------------------


def whole_dollars(c: ColumnLike) -> Column:
    """Whole-dollar currency text, halves rounded away from zero."""
    rounded = F.round(F.abs(col(c)).cast("decimal(38,6)"), 0).cast("decimal(38,0)")
    sign = F.when(col(c) < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, F.format_number(rounded, 0))


def format_value(number: ColumnLike, text: ColumnLike) -> Column:
    """Evidence value as shown: '(null)', currency from 1000 up, else the plain text."""
    plain = F.regexp_replace(col(number).cast("string"), r"(\.\d*?)0+\z", "$1")
    return (
        F.when(F.abs(col(number)) >= 1000, whole_dollars(number))
        .when(col(number).isNotNull(), F.regexp_replace(plain, r"\.\z", ""))
        .otherwise(F.coalesce(col(text), F.lit("(null)")))
    )


def index_tag(total: ColumnLike, departments: ColumnLike) -> Column:
    first = F.coalesce(F.get(col(departments), F.lit(0)), F.lit("Cross-departmental"))
    return F.concat(whole_dollars(total), F.lit(" · "), first)


def host_of(url: ColumnLike) -> Column:
    """Host without a leading www.; a text that is not a URL comes back unchanged."""
    host = F.nullif(F.try_parse_url(col(url), F.lit("HOST")), F.lit(""))
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), col(url))


def mitigation_passed(level: ColumnLike, mitigation: ColumnLike) -> Column:
    pairs = [F.lit(v).cast("int") for kv in REQUIRED_MITIGATION.items() for v in kv]
    return col(mitigation) >= F.try_element_at(F.create_map(*pairs), col(level).cast("int"))


def badge_state(tiers: ColumnLike, label: ColumnLike) -> Column:
    t = col(tiers)
    passed = t["input"]["passed"] & t["contextual"]["passed"] & t["output"]["passed"] & t["audit"]["passed"]
    return F.when(passed & ~col(label).isin("HIGH", "CRITICAL"), F.lit("sage")).otherwise(F.lit("ember"))


def entity_kind(name: ColumnLike, coverage: ColumnLike) -> Column:
    lowered = F.lower(col(name))
    not_fed = ~F.array_contains(col(coverage), "fed")
    return (
        F.when(lowered.contains("aia") | lowered.contains("ai system"), F.lit("aia_system"))
        .when(lowered.contains("shipping") | lowered.contains("contract"), F.lit("contract"))
        .when(F.array_contains(col(coverage), "ab") & not_fed, F.lit("ab_grant"))
        .when(F.array_contains(col(coverage), "cra") & not_fed, F.lit("charity"))
        .otherwise(F.lit("fed_grant"))
    )


def stratum(name: ColumnLike, finding_type: ColumnLike) -> Column:
    upper = F.lower(col(name)).contains("aia") | (col(finding_type) == "outcome_gap")
    return F.when(upper, F.lit("S3")).otherwise(F.lit("S4"))
