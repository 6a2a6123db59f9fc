"""The library's queries by name, and the DuckDB SQL that gives the same rows."""

from wordloom.plans import extraction, library, pages, tables, words
from wordloom.plans.words import flagship

QUERIES = {**words.QUERIES, **tables.QUERIES, **extraction.QUERIES, **pages.QUERIES, **library.QUERIES}
ORACLES = {**words.ORACLES, **tables.ORACLES, **extraction.ORACLES, **pages.ORACLES, **library.ORACLES}

__all__ = ["ORACLES", "QUERIES", "flagship"]
