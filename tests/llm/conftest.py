"""Rows that every operator must take: nulls, empty and long texts, ties, repeats and clashing columns."""

import pytest

SF = "/root/testdata/sf0.001"
CLASHES = "key string, size long, cell int, bin int, shard int, slot int, block long, part int, bucket int, n long, score double, component string, low string, host string, salt int, length int, at string, sig string, ids string, bits string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, None, None, "a"),
        (2, "", "en", None),
        (3, passage, "en", "a"),
        (4, passage, "en", "a"),
        (5, passage + " sixteen", None, "a"),
        (6, "été où ça — 東京 ½ \u0000 😀", "fr", "b"),
        (7, "  \n\t ", "en", "b"),
        (8, "word " * 20_000, "en", "b"),
        (9, "1234 5678", "de", "b"),
        (9, "1234 5678", "de", "b"),
        (10, "a", "de", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    return df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHES.split(", ")])


@pytest.fixture(scope="session")
def no_documents(edge_documents):
    return edge_documents.filter("doc_id < 0")
