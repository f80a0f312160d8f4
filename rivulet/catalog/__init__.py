"""The registered queries over the test tables, and the same queries in SQL."""

from __future__ import annotations

from . import control, ordering, reports, selection, shaping, similarity, streams

MODULES = [selection, shaping, ordering, similarity, control, reports, streams]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
