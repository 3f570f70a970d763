"""The pipeline as a query."""

import corpus_pipeline
from marquee.llm.registry import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
