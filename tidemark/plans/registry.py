"""All registered queries of the library and the SQL that expresses them."""

from __future__ import annotations

from . import feeds, flows, pages, segments, series, texts

QUERIES = texts.QUERIES | pages.QUERIES | feeds.QUERIES | series.QUERIES | segments.QUERIES | flows.QUERIES
ORACLE_SQL = texts.SQL | pages.SQL | feeds.SQL | series.SQL | segments.SQL | flows.SQL
