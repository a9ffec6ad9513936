"""Small tables that hold what the operators must stand: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size string, copies int, d string, score double, chunk int"
SF = "/root/testdata/sf0.001"


def words(n, start=0):
    return " ".join(f"w{(start + i) * 7919 % 5003}" for i in range(n))


def edge_rows():
    base = words(60)
    near = base.replace(" w", " W", 3)
    texts = [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, base + " tail", None), (5, None, "b"), (6, "", "a"), (7, " \t\n ", None), (8, "two words", "b"), (9, "TWO  words", "b"),
        (10, words(30_000, 9), "a"), (10, words(40, 500), "a"), (11, "tie one two three four", "c"), (11, "tie one two three four", "c"), (None, base, "a"), (None, None, None),
        (12, "naïve Ünïcode … 你好 world's end\r\n  double  spaces \x85   kept <|endoftext|>", "c"), (13, "a" * 50_000, "c"),
    ]
    return [(i, t, None if i == 8 else "en", s, len(t or ""), 1, "x", 3, "y", 0.5, 2) for i, t, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
