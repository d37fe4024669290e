"""Name to query and name to SQL, gathered from the plan modules."""

from __future__ import annotations

from loamwork.plans import evaluation, graph, passages, ratings, selection, streams

MODULES = (evaluation, graph, ratings, passages, selection, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
