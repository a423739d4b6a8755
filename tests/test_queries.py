"""Every registered query against its SQL twin in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from agentcorpus import catalogue
from agentcorpus.catalogue import stream_queries
from agentcorpus.session import cut

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = catalogue.load()
# These ask for more rows than the smallest tables hold and run on larger ones.
LARGER = {
    "temperature_sample", "diverse_sample", "nested_tiers", "nested_tier_sizes",
    "suite_sample", "inventory_freeze", "training_ladder",
}
LARGER_FOLDER = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connected(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def duck():
    return {folder: connected(folder) for folder in (FOLDER, LARGER_FOLDER)}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    folder = LARGER_FOLDER if name in LARGER else FOLDER
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    expected = duck[folder].sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    for column, kind in df.dtypes:
        assert TYPES[kind] == kinds[column], (column, kind, kinds[column])
    at = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_policy_amounts_round_half_to_even(spark, tmp_path):
    """A value of 0.1 is half a step: DuckDB casts 0.5 to 0, and so does the query."""
    rows = spark.createDataFrame([("view", v) for v in (0.1, 0.3, 0.5, 0.09, 21.0)], "event_type string, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["parse_policy_outputs"](spark, str(tmp_path)).first()
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = connection.execute(ORACLES["parse_policy_outputs"]).fetchone()
    assert tuple(got) == want and got["parse_errors"] == 3


def test_window_metrics_score_once(spark, monkeypatch):
    """Three arrivals read stored scores; each of them scored all predictions again."""
    stored = []
    monkeypatch.setattr(stream_queries, "cut", lambda *given: stored.append(given[1:]) or cut(*given))
    assert QUERIES["stream_window_metrics"](spark, FOLDER).count() == 20
    assert len(stored) == 1 and "within_element_bounds" in stored[0]


def test_stream_scores_keeps_its_columns_only(spark, monkeypatch, tmp_path):
    """All columns of the predictions went through the shuffle, and all of the scores into the files."""
    monkeypatch.setattr(stream_queries, "scratch", lambda session, label: f"{tmp_path}/{label}")
    found = QUERIES["stream_scores"](spark, FOLDER)
    written = spark.read.parquet(f"{tmp_path}/stream-scores/rows").drop("batch")
    assert written.columns == found.columns == ["id", "run_signature", "parse_success", "within_element_bounds"]
    assert found.count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
