"""All registered queries of this subpackage."""

from marquee.llm import (  # noqa: F401
    alignment_queries, chat_queries, decontaminate_queries, fingerprint_queries, jaccard_queries, pieces_queries, pipeline_queries,
    quality_queries, ranked_queries, sharding_queries, streamed_dedup_queries, substring_queries, toxicity_queries, warc_queries,
)
from marquee.llm.registry import ORACLES, QUERIES  # noqa: F401
