import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away into the dark green wood today", "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away into the dark green wood today", "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away into the dark green wood today", "x"),
    (3, None, "y"),
    (4, "", "y"),
    (5, " \t\n ", None),
    (6, "one two", "z"),
    (7, "ONE two", "z"),
    (None, "the quick brown fox jumps over the lazy dog and runs away into the dark green wood today", "x"),
    (8, "é▁ 日本 🙂 </s>\x00 ok", None),
    (9, "word " * 30_000, "long"),
    (10, "the quick brown fox jumps over the lazy dog and runs away into the dark green wood tomorrow", "x"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, repeated rows, one very long text, and columns that clash with the operators' own."""
    rows = [(i, t, s, -1, "row", 2.5) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, row string, shard double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
