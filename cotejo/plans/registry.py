"""All queries of the library by name, and their SQL for comparison."""

from cotejo.plans import agreement, analysis, coverage, files, search, stores, texts

_MODULES = (coverage, texts, analysis, files, stores, search, agreement)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
