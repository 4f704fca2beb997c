"""All registered queries and their SQL."""

from __future__ import annotations

from . import catalog, signals_study, samples_study  # noqa: F401  (registers its queries)

queries, oracle_sql = catalog.queries, catalog.oracle_sql
