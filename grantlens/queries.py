"""All registered queries and the SQL they are checked against, by name."""

from __future__ import annotations

from .plans import generations, prose, provenance, readers, spending

QUERIES = {**spending.QUERIES, **prose.QUERIES, **provenance.QUERIES, **readers.QUERIES, **generations.QUERIES}
ORACLES = {**spending.ORACLES, **prose.ORACLES, **provenance.ORACLES, **readers.ORACLES, **generations.ORACLES}
