"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import queries_columns  # adds to the tables of the other modules

QUERIES: dict = dict(queries_columns.QUERIES)
SQL: dict = dict(queries_columns.SQL)
