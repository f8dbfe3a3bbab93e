import pytest

# Texts that every operator on documents must take: nulls, empty and long texts,
# repeats, ties, characters outside ASCII and control characters.
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
EDGE_TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "a"),
    (2, "ALPHA beta gamma delta epsilon zeta", "en", "a"),
    (2, "ALPHA beta gamma delta epsilon zeta", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "   \n\t ", None, "b"),
    (6, "É́cole ÉCOLE école İstanbul ẞ", "fr", None),
    (7, "é́cole ÉCOLE école istanbul ẞ", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, LONG, "en", "b"),
    (None, "no id here", "en", "a"),
    (10, "!!! ... ###", "de", "b"),
    (11, "one\x1ctwo\x00three\x85four five <|endoftext|> six", "en", "c"),
    (12, "Released under the MIT License. MIT License", "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _t string, _id int, rank int, kept string"


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, lang, source, len(t) if t else None, "x", 1, 2, "y") for i, t, lang, source in EDGE_TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
