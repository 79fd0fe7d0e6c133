"""Text rules: calibrated language, sentences around a hit, direct quotes, credential shapes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import SPACE, ColumnLike, col, js_trim


@dataclass(frozen=True)
class PhraseRule:
    """anchors may list words (ASCII, lower case) of which every match holds at least one, as a whole word.

    holds may list longer literal texts (ASCII, lower case) of which every match holds one; they are looked for in
    place of the anchors. opens may list the letters (lower case) with which every match begins, at the start of a word. Both only save
    time: a rule runs where a text has one of its anchors, a rule without any runs everywhere.
    """

    kind: str
    pattern: str
    rewrite: str
    anchors: tuple[str, ...] = ()
    opens: str = ""
    holds: tuple[str, ...] = ()


# Forbidden phrase patterns (matched without regard to case) and the advice given.
PHRASE_RULES = (
    PhraseRule("absolute", r"\b(fraud|fraudulent|corrupt(?:ion)?|crime|criminal|illegal(?:ly)?)\b",
               "(drop the editorial verdict; use 'pattern consistent with…' or cite the specific source making the claim)",
               ("fraud", "fraudulent", "corrupt", "corruption", "crime", "criminal", "illegal", "illegally"), "fci"),
    PhraseRule("absolute", r"\b(should have|ought to have|was supposed to)\b",
               "Use 'comparable filings typically state…' or 'records do not contain…'",
               ("should", "ought", "supposed"), "sow", ("should have", "ought to have", "was supposed to")),
    PhraseRule("absolute", r"\b(proves?|proven|definitely|certainly|clearly shows?)\b",
               "Use 'records indicate…' or 'the dataset shows…'",
               ("prove", "proves", "proven", "definitely", "certainly", "clearly"), "pdc"),
    PhraseRule("absolute", r"\b(failed to|refused to|deliberately|intentionally|knowingly)\b",
               "Use 'the dataset does not show…' or 'public records do not contain…'",
               ("failed", "refused", "deliberately", "intentionally", "knowingly"), "frdik", ("failed to", "refused to", "deliberately", "intentionally", "knowingly")),
    PhraseRule("absolute", r"\b(coverups?|cover[- ]ups?|schemes?|scams?)\b",
               "Drop the editorial framing; describe the documented pattern",
               ("coverup", "coverups", "cover", "scheme", "schemes", "scam", "scams"), "cs"),
    PhraseRule("absolute", r"\b(stunning|shocking|egregious|alarming|massive amounts? of public money|astronomical)\b",
               "Drop the superlative; let the number speak",
               ("stunning", "shocking", "egregious", "alarming", "massive", "astronomical"), "seam"),
    PhraseRule("absolute", r"\b(allegedly|reportedly|sources say|many believe|it is widely known)\b",
               "Drop the hedge and cite the specific source by name",
               ("allegedly", "reportedly", "say", "believe", "widely"), "arsmi", ("allegedly", "reportedly", "sources say", "many believe", "it is widely known")),
    PhraseRule("causal", r"\bbecause of\b[^.]{0,80}\b(grant|contract|funding|donation|lobbying)\b",
               "Use temporal description: 'X occurred N days before Y'",
               ("because",), "b", ("because of",)),
    PhraseRule("causal", r"\b(caused|led to|resulted in)\b[^.]{0,80}\b(grant|contract|funding)\b",
               "Replace causal verb with 'preceded' / 'followed' or cite the source asserting the causation",
               ("caused", "led", "resulted"), "clr", ("caused", "led to", "resulted in")),
    PhraseRule("causal", r"\bin (?:exchange|return) for\b",
               "Drop. This phrasing is a quid-pro-quo claim and is unsupported.",
               ("exchange", "return"), "i", ("in exchange for", "in return for")),
    PhraseRule("causal", r"\b(this raises serious questions|warrants investigation|warrants further investigation|the public deserves answers|officials should explain)\b",
               "Drop. The reader-direction is the reader's call, not ours.",
               ("raises", "warrants", "deserves", "explain"), "two"),
)

# Fixed value: credential-shaped text.
SECRET_PATTERN = r"(api[_-]?key|secret|password|bearer)[^a-z0-9]+[a-z0-9]{16,}"

# Opening and closing marks of direct quotes, in the order they are searched.
QUOTE_MARKS = (("“", "”"), ('"', '"'), ("‘", "’"))


WORD = "[0-9A-Za-z_]"
EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def java_pattern(pattern: str) -> str:
    """Case-insensitive Java form of a rule, with word boundaries that look at ASCII letters only.

    Java's own \\b also counts accented letters, in versions that depend on the JDK.
    """
    return "(?i)" + re.sub(r"(\\\\)|\\b", lambda m: m[1] or EDGE, pattern)


def any_phrase(rules: Sequence[PhraseRule] = PHRASE_RULES) -> str:
    """One pattern that hits wherever any of the rules does, case ignored.

    If all rules tell how their matches begin, that is tested first, once per position.
    """
    opens = "".join(sorted({c for r in rules for c in r.opens})) if all(r.opens for r in rules) else ""
    screen = f"(?=[{opens}])(?<!{WORD})" if opens else ""
    return java_pattern(screen + "(?:" + "|".join(f"(?:{r.pattern})" for r in rules) + ")")


def literals(rules: Sequence[PhraseRule]) -> list[str]:
    """Literal texts of which every match of the rules holds one; those that hold another are left out."""
    every = {t for r in rules for t in r.holds or r.anchors}
    return sorted(t for t in every if not any(o != t and o in t for o in every))


def sentence_around(before: Column, match: Column, after: Column) -> Column:
    """Sentence holding a match: from the last full stop before it to the next one after it.

    Without a following full stop the sentence ends 100 characters after the match begins. The
    three parts concatenate to the whole text.
    """
    start = F.substring_index(before, ".", -1)
    closed = F.concat(match, F.substring_index(after, ".", 1), F.lit("."))
    opened = F.substring(F.concat(match, after), 1, 100)
    return js_trim(F.concat(start, F.when(after.contains("."), closed).otherwise(opened)))


def match_and_sentence(text: ColumnLike, halves: Column) -> tuple[Column, Column]:
    """The hit between the two halves of a text that was split at a pattern, and the sentence it stands in."""
    before, after = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    size = F.length(col(text)) - F.length(before) - F.length(after)
    match = F.substring(col(text), F.length(before) + 1, size)
    return match, sentence_around(before, match, after)


def direct_quotes(text: ColumnLike) -> Column:
    """All directly quoted passages: curly double, then straight double, then curly single."""
    found = [
        F.regexp_extract_all(col(text), F.lit(f"{opening}([^{closing}]*){closing}"), F.lit(1))
        for opening, closing in QUOTE_MARKS
    ]
    return F.concat(*found)


def word_count(c: ColumnLike) -> Column:
    return F.size(F.filter(F.split(col(c), f"{SPACE}+"), lambda w: w != ""))


def replace_first_word(text: ColumnLike, word: str, replacement: str) -> Column:
    """Swap the first whole-word occurrence (any case) for a literal replacement."""
    pattern = f"(?i){EDGE}{re.escape(word)}{EDGE}"
    halves = F.split(col(text), pattern, 2)
    swapped = F.concat(F.get(halves, F.lit(0)), F.lit(replacement), F.get(halves, F.lit(1)))
    return F.when(col(text).rlike(pattern), swapped).otherwise(col(text))
