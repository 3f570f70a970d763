"""From raw documents to encoded training text, in five stages.

Every stage takes the documents its predecessor kept and is written before the
next one starts. All but the last return the columns of ``documents``:

1. quality: documents with a quality score under 0.3 go (operator 5).
2. near_duplicates: of each group of linked documents the smallest id stays (3).
3. substrings: words of passages that an earlier document has are cut out, and
   ``n_chars`` follows; texts that lose nothing stay as they are, and a text
   that loses all its words stays as an empty one (7).
4. benchmark: documents that hold a benchmark item go (9).
5. pieces: texts are encoded under merge-dropout; the text is replaced by its
   pieces, which decode to it exactly (8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm import decontaminate, jaccard, pieces, quality, substring
from marquee.llm.pieces_queries import MODEL
from marquee.session import configure, cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.scored(docs.select(*COLUMNS), labels)
    return scored.filter(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    grouped = jaccard.groups(docs.select("doc_id", "text"))
    gone = cut_lineage(grouped.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    few = gone.count() <= jaccard.BROADCAST_IDS
    return docs.select(*COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cut = substring.repeats(docs.select("doc_id", "text"))
    text = F.coalesce("kept", "text")
    return docs.select(*COLUMNS, substring.row_key().alias("row")).join(cut, "row", "left").select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    found = pieces.encoded(docs.select(*COLUMNS), MODEL)
    return found.select("doc_id", "lang", "source", "n_chars", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("quality", good_quality), ("near_duplicates", near_duplicates), ("substrings", substrings),
    ("benchmark", benchmark), ("pieces", encoded),
]
ORACLE_SQL = None  # the first and the last stage have no form in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
