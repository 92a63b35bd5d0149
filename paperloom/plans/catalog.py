"""All registered queries and their SQL."""

from __future__ import annotations

from paperloom.plans import index_oracle, index_queries, oracle, queries

REGISTRY = {**queries.REGISTRY, **index_queries.REGISTRY}
ORACLE = {**oracle.ORACLE, **index_oracle.ORACLE}
