"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from lodestone.plans import indexed, ingest, knowledge, linked, ranking, space

_ALL = {**ranking.QUERIES, **knowledge.QUERIES, **linked.QUERIES, **ingest.QUERIES, **space.QUERIES, **indexed.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
