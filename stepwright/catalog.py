"""Registered queries and their SQL."""

from __future__ import annotations

from stepwright.queries import agreement, chains, files, graphs, ingest, payloads, pools, reports, scalars, search, streams, views  # noqa: F401
from stepwright.queries.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
