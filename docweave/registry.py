"""The core queries by name, and their SQL."""

from __future__ import annotations

from docweave.plans import carriers, packages  # noqa: F401  (they register their queries)
from docweave.plans import queries as core


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
