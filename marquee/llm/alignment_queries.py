"""Query for the alignment of two tokenizers."""

import os

from marquee.llm import alignment
from marquee.llm.registry import query, table

BYTE_LEVEL = os.environ.get("MARQUEE_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("MARQUEE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@query("op12_alignment")
def token_alignment(spark, sf_dir):
    """Tokens, groups and links of every document under two tokenizers."""
    return alignment.link_statistics(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)
