import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from agentcorpus.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x int, place int, state string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows):
    """(ids and integer vectors, n, sums, falling eigenvalues, vectors) by the plain covariance."""
    good = [
        (i, [math.floor(256 * c) for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = max((len(x) for _, x in good), default=0)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = sorted({tuple(x) for _, x in good})
    n = len(fit)
    sums = [sum(column) for column in zip(*fit)]
    z = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return good, n, sums, values[::-1], vectors[:, ::-1]


def compare(spark, rows, parts=3, components=4):
    found = whitening.whiten(frame(spark, rows, parts), components)
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes).replace("bigint", "long") == whitening.OUT
    found = found.collect()
    good, n, sums, values, vectors = brute(rows)
    size = min(components, int((values > 1e-12 * values[0]).sum()))
    mean = np.array([s / n for s in sums])
    got, want = {}, {}
    for r in found:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        key = (r["vec_id"], r["component"], r["deviation"])
        got.setdefault(key, []).append(r["whitened"])
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(size):
            value = (np.array(x) - mean) @ vectors[:, c] / math.sqrt(values[c])
            want.setdefault((i, c + 1, deviation if deviation < 1 << 63 else None), []).append(value)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for c in range(size):
        keys = [k for k in want if k[1] == c + 1]
        a = np.array([x for k in keys for x in sorted(want[k])])
        b = np.array([x for k in keys for x in sorted(got[k])])
        other = np.array([-x for k in keys for x in sorted(got[k], reverse=True)])
        scale = 1e-8 * max(1, np.abs(a).max())
        assert np.abs(a - b).max() < scale or np.abs(a - other).max() < scale


def vectors_of(n, d, seed, spread=1.0):
    noise = np.random.default_rng(seed)
    return (noise.normal(size=(n, d)) * spread ** np.arange(d)).tolist()


@pytest.mark.parametrize("parts", [1, 20])
def test_brute_force(spark, parts):
    rows = list(enumerate(vectors_of(300, 12, 1, 0.8)))
    rows += [(i + 1000, rows[0][1]) for i in range(200)]  # many copies of one vector
    compare(spark, rows, parts)


def test_odd_rows(spark):
    rows = list(enumerate(vectors_of(40, 5, 2)))
    rows += [(1, None), (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [None, 1.0, 1.0, 1.0, 1.0]), (3, [])]
    rows += [(4, [math.nan] * 5), (5, [math.inf] * 5), (6, [0.5]), (6, [0.5]), (6, [0.5, 0.0])]
    compare(spark, rows)


def test_fewer_components_than_asked(spark):
    compare(spark, [(i, [float(i), 2.0 * i, 7.0, float(i * i)]) for i in range(9)])


def test_deviation_beyond_a_long(spark):
    compare(spark, [(i, [1e9 * i, float(i % 3)]) for i in range(30)])


def test_no_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [3.0, 3.0]) for i in range(5)], [(1, None)], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def whole(values, vectors):
    return vectors * values @ vectors.T


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=12))
def test_rank_one_updates(rows):
    values, vectors, want = np.zeros(4), np.eye(4), np.zeros((4, 4))
    for row in np.array(rows, float):
        values, vectors = whitening.rank_one(values, vectors, row)
        want += np.outer(row, row)
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
        assert np.abs(whole(values, vectors) - want).max() < 1e-12 * max(1, np.abs(want).max())
        assert (np.diff(values) >= 0).all()


def test_long_runs_stay_orthogonal():
    rows = np.array(vectors_of(3000, 24, 5, 0.7))
    values, vectors = np.zeros(24), np.eye(24)
    for row in rows:
        values, vectors = whitening.rank_one(values, vectors, row)
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-11
    assert np.abs(whole(values, vectors) - rows.T @ rows).max() < 1e-11 * values[-1]


def test_merged_spectra():
    parts = [np.array(vectors_of(n, 6, n)) for n in (1, 3, 40)]
    spectra = []
    for part in parts:
        state = (np.zeros(6), np.eye(6))
        for row in part:
            state = whitening.rank_one(*state, row)
        spectra.append(state)
    every = np.concatenate(parts)
    assert np.abs(whole(*whitening.merged_spectra(spectra)) - every.T @ every).max() < 1e-10


def test_query(spark, sf):
    from agentcorpus.llm.queries import QUERIES

    source = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    good, n, sums, values, vectors = brute([(r["vec_id"], r["embedding"]) for r in source])
    rows = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    assert len(rows) == 4 * len(good)
    z = {i: np.array(x) - np.array([s / n for s in sums]) for i, x in good}
    signs = {}
    for r in rows:
        c = r["component"] - 1
        want = z[r["vec_id"]] @ vectors[:, c] / math.sqrt(values[c])
        sign = signs.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
        assert abs(want - sign * r["whitened"]) < 1e-8
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        x = dict(good)[r["vec_id"]]
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
