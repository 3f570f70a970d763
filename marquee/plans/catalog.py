"""All registered queries."""

from marquee.plans import (  # noqa: F401
    extract_queries, ingest_queries, listing_queries, place_queries, resolve_queries, search_queries,
)
from marquee.plans.registry import ORACLES, QUERIES  # noqa: F401
