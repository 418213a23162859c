from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))

#: nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing extra columns
ROWS = [
    (1, "The quick brown fox, write to ann.bee@mail.example.com or call +1 (555) 010-2030 now.", "en", "a", 10),
    (2, "The quick brown fox, write to ann.bee@mail.example.com or call +1 (555) 010-2030 now.", "en", "a", 10),
    (2, "The quick brown fox, write to ann.bee@mail.example.com or call +1 (555) 010-2030 now.", "en", "a", 10),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "no id here but some words", "en", "b", 5),
    (5, "  \t\n ", "fr", "b", 3),
    (6, "12345 67890 !!", "de", "b", 3),
    (7, LONG, "en", "c", len(LONG)),
    (8, "start " + PASSAGE + " middle words " + PASSAGE + " end", "fr", "c", 1),
    (9, "other " + PASSAGE + " tail éè \U0001F600 x", "fr", "c", 1),
    (10, "ip 10.20.30.40 and 999.1.1.1 and 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 or 4111111111111112", "es", "c", 1),
    (11, "der die das und nicht mit für auf ein eine", None, "c", 1),
    (12, "The quick brown fox, write to ann.bee@mail.example.com or call +1 (555) 010-2030 now.", "de", "z", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ["fp", "_th", "score", "lang_pred", "n_words", "hit_spans", "k_0", "spans", "component", "_id", "_text", "uid", "k1", "rank"]
    return df.withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
