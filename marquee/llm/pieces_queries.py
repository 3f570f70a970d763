"""Query for the encoding."""

import os

from pyspark.sql import functions as F

from marquee.llm import pieces
from marquee.llm.registry import query, table

MODEL = os.environ.get("MARQUEE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@query("op8_sentencepiece")
def sentencepiece(spark, sf_dir):
    """The pieces of every document under merge-dropout, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.decoded(pieces.encoded(docs, MODEL), MODEL)
    return found.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
