"""Audits of text and link tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ColumnLike, col
from ..functions.text import SECRET_PATTERN
from .skew import distinct_keys

# The shape of a link in page source, and prefixes of links that leave the site.
HREF_PATTERN = r"""href=(?:\{[`"']|["'])([^`"'\s}]+)"""
EXTERNAL_PREFIXES = ("http://", "https://", "mailto:", "tel:", "#", "/api/")


def secret_scan(docs: DataFrame, text: str = "text", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows with credential-shaped text and the first such passage."""
    pattern = "(?i)" + SECRET_PATTERN
    return docs.filter(F.col(text).rlike(pattern)).select(*id_cols, F.regexp_extract(text, pattern, 0).alias("match"))


def internal_paths(html: ColumnLike, external: Sequence[str] = EXTERNAL_PREFIXES):
    """Paths of the internal links of a page, query and fragment removed, in page order."""
    hrefs = F.regexp_extract_all(col(html), F.lit(HREF_PATTERN), F.lit(1))
    outside = "^(?:" + "|".join(re.escape(p) for p in external) + ")"
    inside = F.filter(hrefs, lambda h: ~h.contains("${") & ~h.rlike(outside))
    paths = F.transform(inside, lambda h: F.regexp_extract(h, r"\A[^?#]*", 0))
    return F.filter(paths, lambda p: p.startswith("/"))


def route_pattern(routes: Sequence[str]) -> str:
    """One pattern for route templates: [name] is any one segment, [...name] any rest of the path."""
    def one(route: str) -> str:
        parts = re.split(r"(\[[^\]]+\])", route)
        shown = (".+" if p.startswith("[...") else "[^/]+" if p.startswith("[") else re.escape(p) for p in parts)
        return "".join(shown)

    return r"\A(?:" + "|".join(one(r) for r in routes) + r")\z"


def dead_links(pages: DataFrame, routes: Sequence[str], html: str = "html", id_cols: Sequence[str] = ("page_id",)) -> DataFrame:
    """Internal links that lead to no route, one row per occurrence."""
    links = pages.select(*id_cols, F.explode(internal_paths(html)).alias("path"))
    return links.filter(~F.col("path").rlike(route_pattern(routes)))


def dead_links_table(pages: DataFrame, routes: DataFrame, html: str = "html", id_cols: Sequence[str] = ("page_id",)) -> DataFrame:
    """The same against a table of exact paths (column path), for route lists of any size."""
    links = pages.select(*id_cols, F.explode(internal_paths(html)).alias("path"))
    return links.join(distinct_keys(routes, "path"), "path", "left_anti")
