import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHING = ("rn", "id", "key", "block", "anchor", "k1", "words", "class", "line", "base", "row")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, repeated rows and ids, empty and very long texts, and
    extra columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
        (1, "Another text that has the same id as the one before it does have.", None, None, None),
        (None, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b", 1),
        (None, None, None, None, None),
        (2, None, "en", "a", 0),
        (3, "", "en", "a", 0),
        (4, " \n\n\t ", "de", "a", 5),
        (5, "12345 !!! ???", "de", None, 13),
        (6, long, "en", "a", len(long)),
        (7, long, "en", "c", len(long)),
        (8, "Über den Straßen \U0001f600 schön", "de", "a", 20),
        (9, "x" * 50_000, None, "a", 50_000),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit(name) for name in CLASHING})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def matches(spark, duck, sf):
    """Compare a registered query with its SQL twin."""

    def compare(name):
        from agentcorpus.llm.queries import ORACLES, QUERIES

        df = QUERIES[name](spark, sf)
        wanted = duck.sql(ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(wanted.columns)
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
        at = [wanted.columns.index(c) for c in columns]
        want = sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=repr)
        assert got == want

    return compare
