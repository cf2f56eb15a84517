"""All queries on the graph, retrieval and history operators, by name, with their SQL."""

from __future__ import annotations

from loomgraph.queries import audits, budgets, entities, history, lookup, migration, queues, registry, relational, retrieval, reviews, sources, text, vectors  # noqa: F401  they register their queries

FLAGSHIP = "optional_enrich_collect"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
