import math

from agentcorpus.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, block long"


def brute(rows, every, k=5):
    good = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id not in good or vector < good[vec_id]:
            good[vec_id] = vector
    ints = {i: [math.floor(256 * x) for x in v] for i, v in good.items()}
    out = set()
    for q in ints:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)}
    return out


def run(spark, rows, every):
    frame = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], SCHEMA).repartition(3)
    found = topk.top_k(frame.where(f"vec_id % {every} = 0"), frame)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return {tuple(r) for r in found.collect()}


def test_ties_nulls_and_sparse_vectors(spark):
    rows = [(i, [0.0, float(i % 3), -0.5 * (i % 2), 0.0]) for i in range(60)]
    rows += [(60, None), (None, [1.0, 1.0, 1.0, 1.0]), (62, [1.0, None, 0.0, 0.0])]
    rows += [(63, [float("nan"), 1.0, 1.0, 1.0]), (64, [float("inf"), 0.0, 0.0, 0.0]), (65, [0.0] * 4)]
    rows += [(10, [5.0, 5.0, 5.0, 5.0])]  # an id that repeats
    assert run(spark, rows, 5) == brute(rows, 5)


def test_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "TILE", 2)
    rows = [(i, [math.sin(i * k) for k in range(1, 9)]) for i in range(100)]
    rows += [(i + 100, rows[0][1]) for i in range(30)]  # many copies of one vector
    assert run(spark, rows, 4) == brute([(i, [float(f"{x:.9g}") for x in v]) for i, v in as_floats(rows)], 4)


def test_wide_weights(spark):
    rows = [(i, [1e3 * (i % 7), -3e4 * (i % 3), 0.25]) for i in range(40)]
    assert run(spark, rows, 5) == brute([(i, v) for i, v in as_floats(rows)], 5)


def as_floats(rows):
    import numpy as np

    return [(i, np.asarray(v, np.float32).astype(float).tolist()) for i, v in rows]


def test_few_or_no_rows(spark):
    assert run(spark, [(0, [1.0, 2.0])], 1) == set()
    assert run(spark, [(0, [1.0, 2.0]), (1, [0.5])], 1) == {(0, 1, 1, 32768), (1, 1, 0, 32768)}
    assert run(spark, [], 1) == set()


def test_query(matches):
    matches("op8_exact_top_k")
