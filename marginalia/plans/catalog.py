"""The library's registered queries over the driver tables, and their SQL."""

from __future__ import annotations

from marginalia.plans import log_queries, more_queries, record_queries, relay_queries, search_queries, state_queries, stream_queries, text_queries

QUERIES = {**search_queries.QUERIES, **log_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES, **record_queries.QUERIES, **stream_queries.QUERIES, **state_queries.QUERIES, **relay_queries.QUERIES}
ORACLES = {**search_queries.ORACLES, **log_queries.ORACLES, **text_queries.ORACLES, **more_queries.ORACLES, **record_queries.ORACLES, **stream_queries.ORACLES, **state_queries.ORACLES, **relay_queries.ORACLES}
