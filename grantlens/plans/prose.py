"""Queries over documents, conversations and pages, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import host_of, normalize_name, slugify
from ..functions.text import PHRASE_RULES, SECRET_PATTERN, PhraseRule, direct_quotes, replace_first_word, word_count
from ..operators import audits, briefs, text_checks
from ..operators.tokens import SHORTCOMINGS
from . import inputs as i


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- calibrated language ----------------------------------------------------------------------

# Words of the tables' own prose that stand in for phrases, so that whole texts carry hits.
MARKS = ("CASE WHEN source = 'src3' THEN ' It allegedly led to the contract. ' WHEN source = 'src7' THEN ' Clearly shows it; because of new funding '"
         " WHEN source = 'src11' THEN ' Officials FAILED TO act in return for aid' ELSE '' END")
SWEPT = f"SELECT doc_id, concat(text, {MARKS}, text) AS text FROM documents"


def _swept(spark: SparkSession, d: str) -> DataFrame:
    docs = i.spread_texts(i.texts(spark, d, "documents"), "doc_id", "text")
    return docs.selectExpr("doc_id", f"concat(text, {MARKS}, text) AS text")


def calibration_sweep(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.calibration_sweep(_swept(spark, d), "text", ["doc_id"]).drop("type")


# Rules that open on a group, on no word boundary, on a capital, and on white space.
CUSTOM_RULES = (
    PhraseRule("custom", r"\b(?:the|von|exchange)\b", "drop the article"), PhraseRule("custom", r"tion", "drop the ending"),
    PhraseRule("custom", r"\b(Der|La)\b", "drop the capital"), PhraseRule("custom", r"\s(?:und|de) ", "drop the link"),
)


def calibration_sweep_custom(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.calibration_sweep(i.spread_texts(i.texts(spark, d, "documents"), "doc_id", "text"), "text", ["doc_id"], rules=CUSTOM_RULES).drop("type")


def sweep_sql(relation: str, keys: str, text: str = "text", rules=PHRASE_RULES) -> str:
    """Every rule's first hit in the text, as the reference query for the sweep."""
    parts = []
    for rule in rules:
        p = quoted("(?i)" + rule.pattern)
        lazy = quoted("(?is)^(.*?)" + rule.pattern)
        parts.append(f"""SELECT {keys}, {text} AS t, regexp_extract({text}, {p}, 0) AS m, length(regexp_extract({text}, {lazy}, 1)) AS off,
            {quoted(rule.rewrite)} AS rewrite FROM {relation} WHERE regexp_matches({text}, {p})""")
    hits = " UNION ALL ".join(parts)
    return f"""SELECT {keys}, m AS "match", regexp_replace(concat(regexp_extract(substr(t, 1, off), '[^.]*$', 0),
            CASE WHEN contains(substr(t, off + 1), '.') THEN regexp_extract(substr(t, off + 1), '^[^.]*[.]', 0)
                 ELSE substr(t, off + 1, 100) END), '^\\s+|\\s+$', '', 'g') AS sentence, rewrite FROM ({hits})"""


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents name their tokens 'token = ...'; read as a password line they are credential-shaped."""
    docs = i.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("token = "), F.lit("api_key = ")))
    return audits.secret_scan(docs)


def first_word_rewrite(spark: SparkSession, d: str) -> DataFrame:
    docs = i.texts(spark, d, "documents")
    return docs.select("doc_id", F.md5(replace_first_word("text", "the", "a certain")).alias("digest"))


# --- briefs -----------------------------------------------------------------------------------


def citation_completeness(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.citation_completeness(i.briefs(spark, d), ["doc_id"])


def quote_discipline(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.quote_discipline(i.briefs(spark, d), ["doc_id"])


def citation_completeness_turns(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.citation_completeness_table(i.turns(spark, d), i.turn_sources(spark, d))


def quote_discipline_turns(spark: SparkSession, d: str) -> DataFrame:
    return text_checks.quote_discipline_table(i.turns(spark, d)).drop("quote_no")


def validate_briefs(spark: SparkSession, d: str) -> DataFrame:
    report = briefs.validate_briefs(i.briefs(spark, d, spread=True), ["doc_id"])

    def count(kind: str):
        return F.size(F.filter("violations", lambda v: v["type"] == kind))

    return report.select(
        "doc_id", count("MISSING_CITATION").alias("citations"), count("CALIBRATION_LEAK").alias("leaks"),
        count("QUOTE_REUSED").alias("reused"), count("QUOTE_TOO_LONG").alias("too_long"), "violation_count", "passed",
    )


def brief_violation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of every brief as a row."""
    report = briefs.validate_briefs(i.briefs(spark, d, spread=True), ["doc_id"])
    return briefs.explode_violations(report, ["doc_id"]).select("doc_id", "type", "sentence", "match", "detail", "rewrite")


def brief_stats(spark: SparkSession, d: str) -> DataFrame:
    return briefs.brief_stats(i.briefs(spark, d))


def citation_enrichment(spark: SparkSession, d: str) -> DataFrame:
    rows = briefs.enrich_citations(i.briefs(spark, d))
    grouped = rows.groupBy("briefId", "citation", "title", "year", "authority_tier", "host").agg(F.count("*").alias("uses"))
    return grouped.withColumns({c: F.col(c).cast("double") for c in ("year", "authority_tier")})


def brief_index(spark: SparkSession, d: str) -> DataFrame:
    return briefs.brief_index(i.briefs(spark, d), "outcome")


def briefs_by_name(spark: SparkSession, d: str) -> DataFrame:
    asked = i.table(spark, d, "labels").select(
        F.concat(F.lit("DOCUMENT, "), F.col("doc_id").cast("string"), F.lit(": of src"), (F.col("doc_id") % 20).cast("string")).alias("name")
    )
    return briefs.briefs_by_name(i.briefs(spark, d), asked).select("name", "briefId", "slug")


# --- names and links --------------------------------------------------------------------------


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    p = i.texts(spark, d, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", slugify("title").alias("slug"), normalize_name("title").alias("name_key"))


def citation_hosts(spark: SparkSession, d: str) -> DataFrame:
    p = i.texts(spark, d, "pages")
    return p.groupBy(host_of("url").alias("host")).agg(F.count("*").alias("pages"))


ROUTES = ("/", "/the", "/The", "/de", "/of", "/and", "/[section]ing", "/docs/[...rest]")


def dead_links(spark: SparkSession, d: str) -> DataFrame:
    dead = audits.dead_links(i.texts(spark, d, "pages"), ROUTES)
    return dead.groupBy("page_id", "path").agg(F.count("*").alias("uses"))


def dead_links_by_table(spark: SparkSession, d: str) -> DataFrame:
    """Links to words that no benchmark item contains."""
    words = i.table(spark, d, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    routes = words.select(F.concat(F.lit("/"), "w").alias("path"))
    dead = audits.dead_links_table(i.texts(spark, d, "pages"), routes)
    return dead.groupBy("page_id", "path").agg(F.count("*").alias("uses"))


def quote_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Direct quotes of whole pages by number and words."""
    p = i.texts(spark, d, "pages").select("page_id", direct_quotes("html").alias("quotes"))
    words = F.aggregate("quotes", F.lit(0), lambda acc, q: acc + word_count(q))
    return p.select("page_id", F.size("quotes").alias("quotes"), words.alias("words"))


LINKS = """links AS (SELECT page_id, regexp_extract(h, '^[^?#]*', 0) AS path FROM (
        SELECT page_id, unnest(regexp_extract_all(html, 'href=(?:\\{[`"'']|["''])([^`"''\\s}]+)', 1)) AS h FROM pages)
    WHERE NOT contains(h, '${') AND NOT regexp_matches(h, '^(?:http://|https://|mailto:|tel:|#|/api/)') AND h LIKE '/%')"""

QUOTES = """list_concat(list_concat(regexp_extract_all({t}, '“([^”]*)”', 1), regexp_extract_all({t}, '"([^"]*)"', 1)),
    regexp_extract_all({t}, '‘([^’]*)’', 1))"""
WORDS = "len(list_filter(regexp_split_to_array({q}, '\\s+'), lambda w: w <> ''))"

Q_SENT = f"""sent AS ({i.SENTENCES_SQL}),
    q AS (SELECT doc_id, sentence_no, text, citation, unnest({QUOTES.format(t='text')}) AS quote,
          unnest(range(len({QUOTES.format(t='text')}))) AS quote_no FROM sent),
    qw AS (SELECT *, {WORDS.format(q='quote')} AS words FROM q),
    reuse AS (SELECT *, row_number() OVER (PARTITION BY doc_id, citation ORDER BY sentence_no, quote_no) AS use_no FROM qw WHERE citation IS NOT NULL)"""

BRIEF_TEXT = f"""briefs AS (SELECT doc_id, concat(summary, chr(10), chr(10),
        (SELECT string_agg(s.text, chr(10) || chr(10) ORDER BY sentence_no) || chr(10) || chr(10) FROM sent s WHERE s.doc_id = p.doc_id),
        CASE WHEN source <> '{i.NO_CLAIMS}' THEN concat('Funded outcomes cannot be assessed', chr(10), chr(10)) ELSE '' END,
        CASE WHEN lang = 'de' THEN 'Records are definitely kept.' ELSE '' END) AS text, lang FROM ({i.PROSE_SQL}) p)"""

T_Q = f"""turns AS ({i.TURNS_SQL}), srcs AS ({i.TURN_SOURCES_SQL}),
    q AS (SELECT brief_id, sentence_no, text, citations, unnest({QUOTES.format(t='text')}) AS quote,
          unnest(range(len({QUOTES.format(t='text')}))) AS quote_no FROM turns),
    uses AS (SELECT *, row_number() OVER (PARTITION BY brief_id, c ORDER BY sentence_no, quote_no, c_no) AS use_no
        FROM (SELECT *, unnest(citations) AS c, unnest(range(len(citations))) AS c_no FROM q))"""

QUERIES = {
    f.__name__: f
    for f in (
        calibration_sweep, calibration_sweep_custom, secret_scan, first_word_rewrite, citation_completeness, quote_discipline, citation_completeness_turns,
        quote_discipline_turns, validate_briefs, brief_violation_rows, brief_stats, citation_enrichment, brief_index, briefs_by_name, name_keys,
        citation_hosts, dead_links, dead_links_by_table, quote_lengths,
    )
}

ORACLES = {
    "calibration_sweep": f"WITH swept AS ({SWEPT}) " + sweep_sql("swept", "doc_id"),
    "calibration_sweep_custom": sweep_sql("documents", "doc_id", rules=CUSTOM_RULES),
    "brief_violation_rows": f"""WITH {Q_SENT}, {BRIEF_TEXT}, swept AS ({sweep_sql('briefs', 'doc_id')})
        SELECT doc_id, 'CALIBRATION_LEAK' AS type, sentence, "match", NULL AS detail, rewrite FROM swept
        UNION ALL SELECT doc_id, 'MISSING_CITATION', text, NULL, CASE WHEN citation IS NULL THEN {quoted(text_checks.NO_CITATION)}
            ELSE replace({quoted(text_checks.UNRESOLVED_CITATION)}, '{{}}', citation) END, NULL FROM sent WHERE citation IS NULL OR {i.UNRESOLVED_SQL}
        UNION ALL SELECT doc_id, 'QUOTE_TOO_LONG', text, quote, concat('Direct quote is ', words, ' words; the ceiling is {text_checks.MAX_QUOTE_WORDS}.'), NULL
            FROM qw WHERE words > {text_checks.MAX_QUOTE_WORDS}
        UNION ALL SELECT doc_id, 'QUOTE_REUSED', text, quote, replace({quoted(text_checks.QUOTE_REUSED)}, '{{}}', citation), NULL FROM reuse WHERE use_no > 1
        UNION ALL SELECT doc_id, 'QUOTE_TOO_LONG', NULL, NULL, {quoted(SHORTCOMINGS["quote"])}, NULL FROM documents WHERE lang = 'es'""",
    "secret_scan": f"""SELECT doc_id, regexp_extract(t, {quoted('(?i)' + SECRET_PATTERN)}, 0) AS "match"
        FROM (SELECT doc_id, replace(text, 'token = ', 'api_key = ') AS t FROM documents) WHERE regexp_matches(t, {quoted('(?i)' + SECRET_PATTERN)})""",
    "first_word_rewrite": "SELECT doc_id, md5(regexp_replace(text, '(?i)\\bthe\\b', 'a certain')) AS digest FROM documents",
    "citation_completeness": f"""WITH sent AS ({i.SENTENCES_SQL}) SELECT doc_id, 'MISSING_CITATION' AS type, text AS sentence,
        CASE WHEN citation IS NULL THEN 'No citation pointer on a prose sentence.'
             ELSE concat('Citation ', citation, ' does not resolve to a source in this brief.') END AS detail
        FROM sent WHERE citation IS NULL OR {i.UNRESOLVED_SQL}""",
    "quote_discipline": f"""WITH {Q_SENT} SELECT doc_id, 'QUOTE_TOO_LONG' AS type, text AS sentence, quote AS "match",
        concat('Direct quote is ', words, ' words; the ceiling is 15.') AS detail FROM qw WHERE words > 15
        UNION ALL SELECT doc_id, 'QUOTE_REUSED', text, quote,
        concat('Source ', citation, ' is quoted directly more than once; one direct quote per source maximum.') FROM reuse WHERE use_no > 1""",
    "citation_completeness_turns": f"""WITH {T_Q} SELECT brief_id, sentence_no, 'MISSING_CITATION' AS type, text AS sentence,
        'No citation pointer on a prose sentence.' AS detail FROM turns WHERE len(citations) = 0
        UNION ALL SELECT brief_id, sentence_no, 'MISSING_CITATION', text, concat('Citation ', c, ' does not resolve to a source in this brief.')
        FROM (SELECT *, unnest(citations) AS c FROM turns) t WHERE NOT EXISTS (SELECT 1 FROM srcs s WHERE s.brief_id = t.brief_id AND s.source_id = t.c)""",
    "quote_discipline_turns": f"""WITH {T_Q} SELECT brief_id, sentence_no, 'QUOTE_TOO_LONG' AS type, text AS sentence, quote AS "match",
        concat('Direct quote is ', {WORDS.format(q='quote')}, ' words; the ceiling is 15.') AS detail FROM q WHERE {WORDS.format(q='quote')} > 15
        UNION ALL SELECT brief_id, sentence_no, 'QUOTE_REUSED', text, quote,
        concat('Source ', c, ' is quoted directly more than once; one direct quote per source maximum.') FROM uses WHERE use_no > 1""",
    "validate_briefs": f"""WITH {Q_SENT}, {BRIEF_TEXT}, swept AS ({sweep_sql('briefs', 'doc_id')}),
        c AS (SELECT doc_id, count(*) AS n FROM sent WHERE citation IS NULL OR {i.UNRESOLVED_SQL} GROUP BY 1),
        l AS (SELECT doc_id, count(*) AS n FROM swept GROUP BY 1), r AS (SELECT doc_id, count(*) AS n FROM reuse WHERE use_no > 1 GROUP BY 1),
        w AS (SELECT doc_id, count(*) AS n FROM qw WHERE words > 15 GROUP BY 1)
        SELECT *, cast(citations + leaks + reused + too_long AS int) AS violation_count, citations + leaks + reused + too_long = 0 AS passed FROM (
          SELECT b.doc_id, cast(coalesce(c.n, 0) AS int) AS citations, cast(coalesce(l.n, 0) AS int) AS leaks,
                 cast(coalesce(r.n, 0) AS int) AS reused,
                 cast(coalesce(w.n, 0) + CASE WHEN b.lang = 'es' THEN 1 ELSE 0 END AS int) AS too_long
          FROM briefs b LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id))""",
    "brief_stats": f"""SELECT concat('ob-', doc_id) AS "briefId", CASE WHEN source = '{i.NO_SOURCES}' THEN 0 ELSE 5 END AS source_count,
        CASE WHEN source = '{i.NO_SECTIONS}' THEN 0 ELSE cast(len(string_split(text, chr(10))) AS int) END AS sentence_count FROM documents""",
    "citation_enrichment": f"""WITH sent AS ({i.SENTENCES_SQL}), k AS (SELECT *, CASE WHEN source = '{i.NO_SOURCES}' THEN 9 ELSE try_cast(replace(citation, 'src-', '') AS int) END AS n FROM sent WHERE citation IS NOT NULL)
        SELECT concat('ob-', doc_id) AS "briefId", citation, CASE WHEN n < 5 THEN concat('Source ', n) END AS title,
            CASE WHEN n < 5 THEN cast(2020 + n AS double) END AS year, CASE WHEN n < 5 THEN cast(n + 1 AS double) END AS authority_tier,
            CASE WHEN n < 5 THEN concat(source, '.example.org') END AS host, count(*) AS uses FROM k GROUP BY ALL""",
    "brief_index": """SELECT concat('doc-', doc_id) AS slug, concat('Document ', doc_id, ' of ', source) AS title,
        concat('$', format('{:,}', n_chars), ' · ', source) AS tag, 'outcome' AS brief_type FROM documents WHERE lang = 'en'""",
    "briefs_by_name": """SELECT concat('DOCUMENT, ', l.doc_id, ': of src', l.doc_id % 20) AS name, concat('ob-', d.doc_id) AS "briefId",
        concat('doc-', d.doc_id) AS slug FROM labels l JOIN documents d
        ON concat('document', d.doc_id, 'of', d.source) = concat('document', l.doc_id, 'ofsrc', l.doc_id % 20)""",
    "name_keys": """SELECT page_id, regexp_replace(regexp_replace(replace(lower(t), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS name_key FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""",
    "citation_hosts": """SELECT CASE WHEN regexp_matches(url, '^[a-z]+://') THEN regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www[.]', '')
        ELSE url END AS host, count(*) AS pages FROM pages GROUP BY 1""",
    "dead_links": f"""WITH {LINKS} SELECT page_id, path, count(*) AS uses FROM links
        WHERE NOT regexp_matches(path, '^(?:/|/the|/The|/de|/of|/and|/[^/]+ing|/docs/.+)$') GROUP BY 1, 2""",
    "dead_links_by_table": f"""WITH {LINKS} SELECT page_id, path, count(*) AS uses FROM links WHERE path NOT IN (
        SELECT concat('/', unnest(regexp_split_to_array(text, '[ \\n]'))) FROM benchmark) GROUP BY 1, 2""",
    "quote_lengths": f"""SELECT page_id, cast(len(q) AS int) AS quotes, cast(list_sum(list_transform(q, lambda x: {WORDS.format(q='x')})) AS int) AS words
        FROM (SELECT page_id, {QUOTES.format(t='html')} AS q FROM pages)""",
}
