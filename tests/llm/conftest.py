import pytest

#: One id, nulls, empty, blank, short, long and repeated texts, extra columns with names that operators use inside.
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, "one two", "en", "b", 7),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG + " tail", "en", "b", len(LONG) + 5),
    (9, "Ünïcode 中文 😀 <|endoftext|> text\r\nwith\x1cmarks", "de", "c", 40),
    (None, "a row without an id has words of its own here", "en", "c", 45),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS score", "1 AS shard", "2 AS g", "'y' AS n_tokens", "3 AS block")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
