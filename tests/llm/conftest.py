import pytest

ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One line"), (5, "One line"), (5, "One line"), (6, "one LINE "), (7, "é ü 日本 <|endoftext|> tail"),
    (8, "word " * 3000), (9, "\n".join(f"line {k % 7}" for k in range(400))), (10, "x" * 5000), (11, "a b c d e f g h i j k l m n o p"), (12, "a b c d e f g h i j k l m n o q"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with names that operators use."""
    return spark.createDataFrame([(i, t, "en", 1, "s", "u") for i, t in ROWS], "doc_id long, text string, lang string, count long, t string, key string")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
