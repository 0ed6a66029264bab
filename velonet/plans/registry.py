"""All queries of the library without the training-data operators."""

from __future__ import annotations

from . import network_queries, result_queries, ring_queries, road_queries, source_queries, spatial_queries, stream_queries, table_queries, trip_queries

MODULES = (road_queries, network_queries, spatial_queries, table_queries, source_queries, stream_queries, trip_queries, ring_queries, result_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
