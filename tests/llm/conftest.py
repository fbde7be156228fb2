import pytest

SF = "/root/testdata/sf0.001"

#: Texts with nulls, empties, ties, repeats and a very long one.
EDGE = [(0, ""), (1, None), (2, "one"), (2, "one"), (None, "two words"), (5, "a b c d e f g h " * 20000), (6, "  \t\n "), (7, "Ünïcode — text ✓ 𝄞 " * 7), (8, "A B C"), (9, "a b c")]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component string, shard string, key string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, None if n % 3 else "en", None if n % 4 == 0 else "src0", None, 1, "x", "y", "z") for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
