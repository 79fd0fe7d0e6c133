"""Secret scans in SQL functions: credential shapes, and sliding-window entropy over candidate strings.

Candidates are runs of one character class (hexadecimal digits, base64 characters). A window slides
over each; it keeps the count of every character and the sum of n * log2(n), both changed only at the
character that enters and the one that leaves, so its Shannon entropy costs the same at any width.
Candidates on the allow-list (words, numbers and any number of them joined, UUIDs, marked examples) are
passed over. Words run together by capitals are words if they can be read: few pieces that are neither
known nor hold a vowel, and pieces of 3.3 letters on average.
The bound of a class is a share of what random characters reach in a window, so that chance repeats in a
short random token do not hide it; what keeps text out is the allow-list.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shape(NamedTuple):
    """A credential shape: matches count if the group has that many characters."""

    kind: str
    pattern: str
    group: int
    least: int


class CharacterClass(NamedTuple):
    kind: str
    alphabet: str
    characters: str
    bits: float


#: In a run of such characters the first match takes all of the run, so the length can stand in the pattern.
SHAPES = (
    Shape("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Shape("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Shape("hex", "[0-9a-f]{16,}", 0, 16),
)
WINDOW = 16
#: Of the mean entropy of random windows; fewer than one random window in a hundred falls below.
LEAST_SHARE = 0.82


def reach(symbols: int, window: int) -> float:
    """Mean entropy in bits of so many characters drawn at random from so many symbols."""
    p = 1 / symbols
    return math.log2(window) - symbols / window * sum(
        math.comb(window, n) * p ** n * (1 - p) ** (window - n) * n * math.log2(n) for n in range(2, window + 1))


#: Base64's characters also write tokens of 32 or 36 symbols, so 32 are what its bound is taken from.
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", "0-9a-fA-F", LEAST_SHARE * reach(16, WINDOW)),
    CharacterClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "A-Za-z0-9+/_=-", LEAST_SHARE * reach(32, WINDOW)),
)
#: What joins parts, a part read at once (one case or capitalised, up to four digits, or a number), and one that needs a closer look.
BETWEEN = "[/_=+-]+"
PLAIN = "^(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)$"
JOINED = "^[A-Za-z]+[0-9]{0,4}$"
ALONE = "^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"
#: Short words and abbreviations that names are made of; all other pieces need three letters and a vowel.
KNOWN = ("a", "an", "as", "at", "be", "by", "do", "go", "he", "id", "if", "in", "io", "is", "it", "me", "my", "no", "of", "ok", "on", "or", "so", "to", "ui",
         "up", "us", "we", "css", "html", "http", "sql", "ssh", "tcp", "xml")
READABLE = "^(?:[A-Z]{3,5}|[A-Z]?[a-z]*[aeiouy][a-z]*|[AEIOUY][a-z]+)$"
#: Other candidates that are no secrets.
ALLOWED = ("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")
SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"' if '"' not in text else "concat(" + ", ".join(
        'r"\'"' if part == "'" else f"r'{part}'" for part in text.replace("'", "\0'\0").split("\0") if part) + ")"


def _sums(numbers: str, start: str) -> str:
    """SQL for what each number of an array has before it, from `start`."""
    return f"""aggregate({numbers}, named_struct('at', {start}, 'out', array_repeat(0L, 0)),
        (s, n) -> named_struct('at', s.at + n, 'out', concat(s.out, array(s.at))), s -> s.out)"""


def _located(text: str, pattern: str) -> str:
    """SQL for [(start, match)] of all matches. Matches and the pieces between them alternate, so lengths add up to places.

    They are added up in blocks of about the square root of their number, since an array that grows is copied each time.
    """
    p = _quoted(pattern)
    block = "CAST(ceil(sqrt(greatest(size(h.l), 1))) AS int)"
    blocks = f"transform(sequence(0, greatest(CAST(ceil(size(h.l) / {block}) AS int) - 1, 0)), k -> slice(h.l, k * {block} + 1, {block}))"
    totals = "transform(b, c -> aggregate(c, 0L, (t, n) -> t + n))"
    before = f"transform(array({blocks}), b -> flatten(transform(arrays_zip(b, {_sums(totals, '0L')}), c -> {_sums('c.b', 'c.`1`')})))[0]"
    held = f"""transform(array(regexp_extract_all({text}, {p}, 0)), f -> named_struct('f', f, 'g', slice(split({text}, {p}, -1), 1, size(f))))"""
    sized = f"transform({held}, h -> named_struct('f', h.f, 'g', h.g, 'l', transform(h.f, (m, i) -> CAST(length(m) + length(h.g[i]) AS bigint))))"
    return f"""flatten(transform({sized}, h -> transform(arrays_zip(h.f, h.g, {before}), x -> named_struct('start', x.`2` + length(x.g), 'match', x.f))))"""


def _empty() -> str:
    return f"CAST(array() AS array<{SPAN}>)"


def shape_spans(text: str, rank: int, shape: Shape) -> Column:
    body = f"""transform(filter({_located(text, shape.pattern)},
            x -> length(regexp_extract(x.match, {_quoted(shape.pattern)}, {shape.group})) >= {shape.least}),
        x -> named_struct('start', x.start, 'rank', {rank}, 'kind', '{shape.kind}', 'stop', x.start + length(x.match)))"""
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(shape.pattern)} THEN {body} ELSE {_empty()} END")


def readable(part: str) -> str:
    """SQL for whether letters (digits after them left out) are words run together by capitals."""
    pieces = f"split(regexp_replace(regexp_replace(regexp_replace({part}, '[0-9]+$', ''), '([a-z])([A-Z])', '$1 $2'), '([A-Z])([A-Z][a-z])', '$1 $2'), ' ')"
    known = ", ".join(f"'{w}'" for w in KNOWN)
    odd = f"filter(w, o -> NOT (lower(o) IN ({known}) OR (length(o) >= 3 AND o RLIKE '{READABLE}')))"
    return f"transform(array({pieces}), w -> 5 * size({odd}) <= size(w) AND 10 * length(array_join(w, '')) >= 33 * size(w))[0]"


def benign(match: str, allowed: tuple[str, ...]) -> str:
    """SQL for whether a candidate is on the allow-list. Parts are judged one by one, so their number has no bound."""
    def part(p: str) -> str:
        return f"({p} RLIKE '{PLAIN}' OR ({p} RLIKE '{JOINED}' AND {readable(p)}))"

    alone = f"(q[0] RLIKE '{ALONE}' OR (q[0] RLIKE '^[A-Za-z]+$' AND {readable('q[0]')}))"
    example = f"({match} RLIKE '[A-Za-z0-9]=*$' AND q[size(q) - 1] RLIKE 'EXAMPLE|example' AND forall(slice(q, 1, size(q) - 1), p -> {part('p')}))"
    plain = f"CASE WHEN size(q) = 0 THEN true WHEN size(q) = 1 AND {alone} THEN true WHEN size(q) > 1 AND forall(q, p -> {part('p')}) THEN true ELSE {example} END"
    parts = f"filter(split({match}, '{BETWEEN}'), p -> p <> '')"
    others = _quoted("^(?:" + "|".join(allowed) + ")$") if allowed else "'^$'"
    return f"({match} RLIKE {others} OR transform(array({parts}), q -> {plain})[0])"


def entropy_spans(text: str, rank: int, kind: CharacterClass, window: int, allowed: tuple[str, ...]) -> Column:
    """From the first to the last window of each candidate that reaches the class's entropy.

    Counts are a string with a character per character of the class, of code 64 and the count, so that a step
    reads and changes two places of it and no others.
    """
    pattern = f"[{kind.characters}]{{{window},}}"
    logs = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    gain = "array(" + ", ".join(f"{b - a!r}D" for a, b in zip(logs, logs[1:])) + ")"
    codes = f"transform(split(x.match, ''), c -> instr('{kind.alphabet}', c))"

    def step(acc: str, code: str, by: int) -> str:
        """counts and total with one character more or less."""
        held = f"ascii(substring({acc}.counts, {code}, 1))"
        change = f"+ {gain}[{held} - 64]" if by > 0 else f"- {gain}[{held} - 65]"
        return f"named_struct('counts', overlay({acc}.counts PLACING char({held} + {by}) FROM {code} FOR 1), 'total', {acc}.total {change})"

    both = "named_struct('counts', acc.counts, 'total', acc.total)"
    into = f"transform(array({step('acc', 'y.`0`', 1)}), e -> IF(y.`1` < 0, e, {step('e', 'y.`1`', -1)}))[0]"
    hot = f"y.`2` >= {window} AND {math.log2(window)!r}D - m.total / {window} >= {kind.bits!r}D"
    slid = f"""aggregate(arrays_zip({codes}, concat(array_repeat(-1, {window}), {codes}), sequence(1, length(x.match))),
        named_struct('counts', repeat('@', {len(kind.alphabet)}), 'total', 0D, 'first', -1, 'last', -1),
        (acc, y) -> CASE WHEN y.`2` IS NULL THEN acc ELSE transform(array(IF(y.`0` = y.`1`, {both}, {into})), m -> named_struct(
            'counts', m.counts, 'total', m.total, 'first', IF(acc.first < 0 AND {hot}, y.`2` - {window}, acc.first), 'last', IF({hot}, y.`2`, acc.last)))[0] END)"""
    body = f"""transform(filter(transform(filter({_located(text, pattern)}, x -> NOT {benign('x.match', allowed)}),
            x -> named_struct('at', x.start, 'slid', {slid})), x -> x.slid.first >= 0),
        x -> named_struct('start', x.at + x.slid.first, 'rank', {rank}, 'kind', '{kind.kind}', 'stop', x.at + x.slid.last))"""
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN {body} ELSE {_empty()} END")


def with_spans(docs: DataFrame, text: str, spans: str, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with one more column, the spans of secrets in code points by start, then kind as listed.

    A null text is empty. Spans of different kinds may overlap. The allow-list touches candidates of
    high entropy only, never the credential shapes.
    """
    whole = "_llm_scanned"
    parts = [shape_spans(whole, k, s) for k, s in enumerate(SHAPES)]
    parts += [entropy_spans(whole, len(SHAPES) + k, c, window, allowed) for k, c in enumerate(CLASSES)]
    read = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    return read.withColumn(spans, F.array_sort(F.concat(*parts)).cast(f"array<{SPAN}>")).drop(whole)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) per row of docs, repeated rows and rows without a key included."""
    return with_spans(docs.select(F.col(key).alias("_llm_key"), F.col(text).alias("_llm_text")), "_llm_text", "spans").select(
        F.col("_llm_key").alias(key), "spans")


def written(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts of the credential shapes, a digest of their spans, and all spans as text."""
    base = found.withColumn("_base", F.expr(f"filter(spans, x -> x.rank < {len(SHAPES)})"))
    counts = [F.expr(f"CAST(size(filter(_base, x -> x.rank = {k})) AS bigint) AS n_{s.kind}") for k, s in enumerate(SHAPES)]
    return base.select("doc_id", *counts, F.sha2(written("_base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every span of a secret replaced by a mark; overlapping spans get one. A null text stays null."""
    found = with_spans(docs, text, "_llm_spans")
    cut = f"""aggregate(_llm_spans, named_struct('at', 0L, 'out', array_repeat('', 0)),
        (acc, x) -> CASE WHEN x.start >= acc.at OR acc.at = 0
            THEN named_struct('at', x.stop, 'out', concat(acc.out, array(substring(`{text}`, CAST(acc.at AS int) + 1, CAST(x.start - acc.at AS int)), '{mark}')))
            ELSE named_struct('at', greatest(acc.at, x.stop), 'out', acc.out) END,
        acc -> array_join(concat(acc.out, array(substring(`{text}`, CAST(acc.at AS int) + 1))), ''))"""
    return found.withColumn(text, F.expr(f"CASE WHEN size(_llm_spans) = 0 THEN `{text}` ELSE {cut} END")).drop("_llm_spans")
