"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from strophe.plans import artist_queries, corpus_queries, editorial_queries, lookup_queries, payload_queries, resolve_queries, song_queries, source_queries

FAMILIES = (artist_queries, song_queries, corpus_queries, resolve_queries, lookup_queries, editorial_queries, payload_queries, source_queries)
QUERIES = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
