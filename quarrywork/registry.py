"""The library's queries by name, and the SQL that each is compared with."""

from __future__ import annotations

from .plans import ORACLE_SQL, QUERIES, aggregates, catalogs, code, composites, files, graphs, joins, rules, scalars, search, streams, texts, windows

FLAGSHIP = "Z01"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "aggregates", "catalogs", "code", "composites", "files", "graphs", "joins", "rules", "scalars", "search", "streams", "texts", "windows"]
