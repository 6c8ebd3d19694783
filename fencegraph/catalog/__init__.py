"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from fencegraph.catalog import (
    analytics_queries,
    entity_queries,
    evaluation_queries,
    fence_queries,
    identity_queries,
    prep_queries,
    relation_queries,
    search_queries,
    social_queries,
    store_queries,
    stream_queries,
)

QUERIES = {}
ORACLES = {}
for _m in (fence_queries, analytics_queries, prep_queries, entity_queries, relation_queries, social_queries, identity_queries, search_queries, evaluation_queries, store_queries, stream_queries):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
