"""Checks on prose: calibrated language, citations, direct quotes.

Two input shapes are served. Nested briefs are checked inside the row, without any shuffle.
Sentence tables (one row per sentence) use joins and partial aggregates, so that a brief of any
size never has to fit one task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ColumnLike, bind, col
from ..functions.text import PHRASE_RULES, PhraseRule, any_phrase, direct_quotes, literals, match_and_sentence, word_count
from ..session import Stages, stages_of
from .skew import distinct_keys, reduce_by

# The word limit of a direct quote and the wording of the details reported.
MAX_QUOTE_WORDS = 15
NO_CITATION = "No citation pointer on a prose sentence."
UNRESOLVED_CITATION = "Citation {} does not resolve to a source in this brief."
QUOTE_TOO_LONG = "Direct quote is {} words; the ceiling is {}."
QUOTE_REUSED = "Source {} is quoted directly more than once; one direct quote per source maximum."

VIOLATION = "struct<type:string,sentence:string,match:string,detail:string,rewrite:string>"


def violation(
    kind: str,
    sentence: Column | None = None,
    match: Column | None = None,
    detail: Column | None = None,
    rewrite: Column | None = None,
) -> Column:
    def text(c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else c

    return F.struct(
        F.lit(kind).alias("type"),
        text(sentence).alias("sentence"),
        text(match).alias("match"),
        text(detail).alias("detail"),
        text(rewrite).alias("rewrite"),
    )


def filled(wording: str, *values: Column | str) -> Column:
    """The wording with its {} places filled in."""
    pieces = wording.split("{}")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [F.lit(value) if isinstance(value, str) else value, F.lit(piece)]
    return F.concat(*out)


def present(c: Column) -> Column:
    """The array, or an empty one where a document leaves it out."""
    return F.coalesce(c, F.array())


def no_violations() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


# --- calibrated language ----------------------------------------------------------------------


def phrase_violations(text: ColumnLike, rules: Sequence[PhraseRule] = PHRASE_RULES) -> Column:
    """First hit of every rule in the text, in rule order.

    The literal texts that a rule can't do without are searched in the text in small letters, and only rules
    that have one there run. Rules that name none share one scan for all of them.
    """
    anchored, others = [r for r in rules if r.anchors], [r for r in rules if not r.anchors]

    def among(small: Column, wanted: Sequence[PhraseRule]) -> Column:
        return functools.reduce(Column.__or__, [small.contains(t) for t in literals(wanted)])

    def hit(whole: Column, rule: PhraseRule) -> Column:
        def found(halves: Column) -> Column:
            match, sentence = match_and_sentence(whole, halves)
            return F.when(F.size(halves) == 2, violation("CALIBRATION_LEAK", sentence, match, None, F.lit(rule.rewrite)))

        return bind(F.split(whole, any_phrase((rule,)), 2), found)

    def checked(whole: Column, small: Column | None) -> Column:
        hits = [F.when(among(small, [rule]), hit(whole, rule)) if rule.anchors else hit(whole, rule) for rule in rules]
        listed = F.filter(F.array(*hits), lambda v: v.isNotNull()).cast(f"array<{VIOLATION}>")
        screens = [among(small, anchored)] if anchored else []
        screens += [whole.rlike(any_phrase(others))] if others else []
        return F.when(functools.reduce(Column.__or__, screens), listed).otherwise(no_violations()) if screens else no_violations()

    def screened(whole: Column) -> Column:
        return bind(F.lower(whole), lambda small: checked(whole, small)) if anchored else checked(whole, None)

    return bind(col(text), screened)  # a text put together from parts is put together once


def calibration_sweep(
    df: DataFrame, text: str, id_cols: Sequence[str], per_sentence: bool = False, rules: Sequence[PhraseRule] = PHRASE_RULES
) -> DataFrame:
    """One row per (text, rule) hit. Stateless, so it takes streaming DataFrames as well.

    per_sentence applies the rules to each sentence on its own, reporting the first hit in each.
    """
    if per_sentence:
        df = df.withColumn(text, F.explode(F.split(text, r"(?<=\.)")))
    return df.select(*id_cols, F.inline(phrase_violations(text, rules))).drop("detail")


# --- nested briefs ----------------------------------------------------------------------------


def brief_sentences(sections: ColumnLike = "publicSources") -> Column:
    """Sentences of all sections in order; absent lists are empty, an absent text is an empty one."""
    every = F.flatten(F.transform(present(col(sections)), lambda s: present(s["sentences"])))
    whole = F.filter(every, lambda s: s.isNotNull())
    return F.transform(whole, lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), present(s["citations"]).alias("citations")))


def citation_violations(sections: ColumnLike = "publicSources", sources: ColumnLike = "sources") -> Column:
    """A sentence without citations, and each citation that names none of the brief's sources."""
    def check(s: Column, known: Column) -> Column:
        missing = F.array(violation("MISSING_CITATION", s["text"], None, F.lit(NO_CITATION)))
        loose = F.filter(s["citations"], lambda c: ~F.coalesce(F.array_contains(known, c), F.lit(False)))
        named = F.transform(
            loose,
            lambda c: violation("MISSING_CITATION", s["text"], None, filled(UNRESOLVED_CITATION, F.coalesce(c, F.lit("null")))),
        )
        return F.when(F.size(s["citations"]) == 0, missing).otherwise(named)

    ids = F.transform(present(col(sources)), lambda s: s["id"])
    return bind(ids, lambda known: F.flatten(F.transform(brief_sentences(sections), lambda s: check(s, known))))


def _too_long(sentence: Column, quote: Column, max_words: int) -> Column:
    detail = filled(QUOTE_TOO_LONG, word_count(quote).cast("string"), str(max_words))
    return violation("QUOTE_TOO_LONG", sentence, quote, detail)


def _reused(sentence: Column, quote: Column, source: Column) -> Column:
    return violation("QUOTE_REUSED", sentence, quote, filled(QUOTE_REUSED, source))


def _quotes_of(s: Column) -> Column:
    return F.transform(
        direct_quotes(s["text"]),
        lambda q: F.struct(s["text"].alias("text"), q.alias("quote"), s["citations"].alias("citations")),
    )


def _uses_of(q: Column) -> Column:
    return F.transform(
        q["citations"], lambda c: F.struct(q["text"].alias("text"), q["quote"].alias("quote"), c.alias("source"))
    )


def _reuses(uses: Column) -> Column:
    """Uses of a source after its first one, in their order. Sorted by source, a reuse follows a use of the same."""
    cited = F.filter(uses, lambda u: u["source"].isNotNull())
    placed = F.array_sort(F.transform(cited, lambda u, i: F.struct(u["source"].alias("source"), i.alias("i"), u.alias("u"))))

    def after(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda n, k: F.struct(n["i"].alias("i"), n["u"].alias("u"), (F.get(ordered, k - 1)["source"] == n["source"]).alias("again")),
        )
        return F.array_sort(F.filter(marked, lambda n: n["again"]))

    return F.transform(bind(placed, after), lambda n: _reused(n["u"]["text"], n["u"]["quote"], n["u"]["source"]))


def quote_violations(sections: ColumnLike = "publicSources", max_words: int = MAX_QUOTE_WORDS) -> Column:
    """Quotes over the word limit, and every direct quote of a source after its first."""
    def check(quotes: Column) -> Column:
        wordy = F.filter(quotes, lambda q: word_count(q["quote"]) > max_words)
        long = F.transform(wordy, lambda q: _too_long(q["text"], q["quote"], max_words))
        return F.concat(long, bind(F.flatten(F.transform(quotes, _uses_of)), _reuses))

    return bind(F.flatten(F.transform(brief_sentences(sections), _quotes_of)), check)


def citation_completeness(briefs: DataFrame, id_cols: Sequence[str] = ("briefId",)) -> DataFrame:
    return briefs.select(*id_cols, F.inline(citation_violations())).drop("match", "rewrite")


def quote_discipline(briefs: DataFrame, id_cols: Sequence[str] = ("briefId",), max_words: int = MAX_QUOTE_WORDS) -> DataFrame:
    return briefs.select(*id_cols, F.inline(quote_violations(max_words=max_words))).drop("rewrite")


# --- sentence tables --------------------------------------------------------------------------


def citation_completeness_table(
    sentences: DataFrame,
    sources: DataFrame,
    brief: str = "brief_id",
    order: Sequence[str] = ("sentence_no",),
    text: str = "text",
    citations: str = "citations",
    source: str = "source_id",
) -> DataFrame:
    """citation_completeness over one row per sentence and one row per (brief, source)."""
    def out(df: DataFrame, detail: Column) -> DataFrame:
        return df.select(brief, *order, F.lit("MISSING_CITATION").alias("type"), F.col(text).alias("sentence"), detail.alias("detail"))

    bare = out(sentences.filter(F.size(present(F.col(citations))) == 0), F.lit(NO_CITATION))
    cited = sentences.select(brief, *order, text, F.explode(citations).alias(source))
    loose = cited.join(distinct_keys(sources, brief, source), [brief, source], "left_anti")
    return bare.unionByName(out(loose, filled(UNRESOLVED_CITATION, F.col(source))))


def quote_discipline_table(
    sentences: DataFrame,
    brief: str = "brief_id",
    order: Sequence[str] = ("sentence_no",),
    text: str = "text",
    citations: str = "citations",
    max_words: int = MAX_QUOTE_WORDS,
    stages: Stages | None = None,
) -> DataFrame:
    """quote_discipline over one row per sentence.

    A use is a reuse when an earlier one exists, so the first use per (brief, source) is enough: a partial
    aggregate and a join instead of a running count over a possibly huge group. Quotes are found once: over-long
    quotes and uses leave the sentences as one table of tagged rows, which all later steps read.
    """
    stages = stages or stages_of(sentences.sparkSession)
    quotes = sentences.select(brief, *order, text, citations, F.posexplode(direct_quotes(text)).alias("quote_no", "quote"))
    # One row for the quote itself (cit_no -1) if it is over-long, and one per citation.
    use = F.transform(present(F.col(citations)), lambda c, at: F.struct(at.alias("cit_no"), c.alias("source_id")))
    own = F.array(F.struct(F.lit(-1).alias("cit_no"), F.lit(None).cast("string").alias("source_id")))
    tags = F.concat(F.when(word_count("quote") > max_words, own).otherwise(F.slice(own, 1, 0)), use)
    tagged = stages.add(quotes.select(brief, *order, text, "quote_no", "quote", F.inline(tags)))
    shown = [brief, *order, "quote_no"]
    long = tagged.filter("cit_no < 0").select(*shown, F.inline(F.array(_too_long(F.col(text), F.col("quote"), max_words))))
    uses = tagged.filter("cit_no >= 0 AND source_id IS NOT NULL")
    place = F.struct(*order, "quote_no", "cit_no")
    firsts = reduce_by(uses, [brief, "source_id"], F.min(place).alias("first_use"))
    again = uses.join(firsts, [brief, "source_id"]).filter(place > F.col("first_use"))
    reused = again.select(*shown, F.inline(F.array(_reused(F.col(text), F.col("quote"), F.col("source_id")))))
    return long.unionByName(reused).drop("rewrite")
