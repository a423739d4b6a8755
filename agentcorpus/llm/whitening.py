"""Operator 12: whitening of embeddings by incremental eigendecomposition.

Every partition of the distinct vectors keeps the eigenvalues and eigenvectors of its own scatter matrix
and updates them with one centred vector after another: a rank-one update solves the secular equation for
the new eigenvalues and leaves out (deflates) what does not change.  Spectra are merged, eight at a time,
by rank-one updates with the scaled eigenvectors of the others.  The merged basis then goes through one
Rayleigh-Ritz step whose projected matrix is summed over all partitions, which removes what the many
updates lost in precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.llm.store import partitions, stored

SCALE = 256
LARGEST = float(1 << 62)  # scaled entries must lie below, to fit a long
FAN = 8  # partial states merged by one task
STATE = "place long, state binary"
EPS = np.finfo(np.float64).eps
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame, *kept: str) -> DataFrame:
    """Rows whose vector is whole and finite, with ``x`` = floor(256 * entry) as longs."""
    entry = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    whole = vectors.where(F.col("embedding").isNotNull() & ~bad)
    return whole.select(*kept, F.transform(entry, lambda c: F.floor(c).cast("long")).alias("x"))


def padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


# rank-one updates


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Differences (root j - pole i) of the roots of 1 + sum weights / (poles - root), poles ascending.

    Root j lies between poles j and j + 1, the last one within the sum of weights above the last pole.
    A root is held as its distance from the nearer pole, so differences keep their digits; steps of
    rational interpolation through both neighbouring poles are replaced by halving where they leave the
    bracket.
    """
    k, total = len(poles), weights.sum()
    gaps = np.append(np.diff(poles), total)
    middle = poles + gaps / 2
    value = 1 + (weights / (poles - middle[:, None])).sum(axis=1)
    right = value < 0  # the root lies in the upper half of its gap
    right[-1] = False
    origin = np.arange(k) + right
    poles_from = poles[None, :] - poles[origin][:, None]
    low = np.where(right, -gaps / 2, 0.0)
    high = np.where(right, 0.0, np.append(gaps[:-1] / 2, total))
    tau = (low + high) / 2
    below = np.tri(k, dtype=bool)  # pole i <= j
    rows, after = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    last = rows == k - 1
    open_ = np.ones(k, bool)
    for _ in range(200):
        apart = poles_from - tau[:, None]
        parts = weights / apart
        slopes = parts / apart
        psi, phi = np.where(below, parts, 0).sum(1), np.where(below, 0, parts).sum(1)
        psi_slope, phi_slope = np.where(below, slopes, 0).sum(1), np.where(below, 0, slopes).sum(1)
        value = 1 + psi + phi
        open_ &= np.abs(value) > 4 * EPS * k * (1 + np.abs(psi) + np.abs(phi))
        low, high = np.where(value < 0, tau, low), np.where(value > 0, tau, high)
        open_ &= high - low > EPS * np.maximum(np.abs(low), np.abs(high))
        if not open_.any():
            break
        d1, d2 = apart[rows, rows], np.where(last, 1.0, apart[rows, after])
        s1, s2 = d1 * d1 * psi_slope, np.where(last, 0.0, d2 * d2 * phi_slope)
        c = 1 + psi - d1 * psi_slope + np.where(last, 0.0, phi - d2 * phi_slope)
        a = c * (d1 + d2) + s1 + s2
        b = c * d1 * d2 + s1 * d2 + s2 * d1
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(last, d1 + s1 / c, step)
            new = tau + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        tau = np.where(open_, np.where(inside, new, (low + high) / 2), tau)
    return tau[:, None] - poles_from


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of Q diag(values) Q' + z z'."""
    w = vectors.T @ z
    norm = float(w @ w)
    if norm == 0:
        return values, vectors
    small = 8 * EPS * max(abs(values[-1]), abs(values[0]), norm)
    active = np.abs(w) * np.sqrt(norm) > small
    if np.count_nonzero(active) > 1:
        at = np.flatnonzero(active)
        gaps = np.diff(values[at])
        if (gaps * np.abs(w[at[1:]] * w[at[:-1]]) / (w[at[1:]] ** 2 + w[at[:-1]] ** 2) <= small).any():
            vectors = vectors.copy()
            kept = at[0]
            for i in at[1:]:  # rotate the weight of (nearly) equal values onto the later one
                r = np.hypot(w[kept], w[i])
                c, s = w[i] / r, w[kept] / r
                if (values[i] - values[kept]) * abs(c * s) <= small:
                    first, second = vectors[:, kept].copy(), vectors[:, i].copy()
                    vectors[:, kept], vectors[:, i] = c * first - s * second, s * first + c * second
                    w[i], w[kept], active[kept] = r, 0.0, False
                kept = i
    at = np.flatnonzero(active)
    if not len(at):
        return values, vectors
    values = values.copy()
    moved = secular_roots(values[at], w[at] ** 2)  # [j, i] = root j - pole i
    poles, k = values[at], len(at)
    # weights for which the computed roots are exact: orthogonal eigenvectors follow from them
    apart = poles[:, None] - poles[None, :]
    earlier = np.tri(k, k, -1, dtype=bool).T  # j < i
    other = np.where(earlier, apart, np.roll(apart, -1, axis=0))
    other[-1, :] = 1.0
    weights = np.sqrt(np.abs(np.prod(moved / other, axis=0))) * np.where(w[at] < 0, -1.0, 1.0)
    turn = weights[:, None] / -moved.T
    turn /= np.linalg.norm(turn, axis=0)
    nearest = np.abs(moved).argmin(axis=1)
    values[at] = poles[nearest] + moved[np.arange(k), nearest]
    vectors = vectors.copy()
    vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def merged_spectra(spectra: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum: the first one updated with the scaled eigenvectors of the others."""
    values, vectors = spectra[0]
    for more_values, more_vectors in spectra[1:]:
        for value, vector in zip(more_values, more_vectors.T):
            if value > 0:
                values, vectors = rank_one(values, vectors, np.sqrt(value) * vector)
    return values, vectors


# partial states


def partial(rows: DataFrame, fold: Callable, start: Callable) -> DataFrame:
    """A row per partition with ``fold`` applied to its batches of x vectors, from ``start()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
                state, some = fold(state, flat.reshape(batch.num_rows, -1)), True
        if some:
            yield pa.RecordBatch.from_pydict(
                {"place": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]},
                schema=pa.schema([("place", pa.int64()), ("state", pa.binary())]),
            )

    return rows.select("x").mapInArrow(run, STATE)


def total(parts: DataFrame, merge: Callable):
    """The merged state of all rows, FAN states to a task in every round; None without rows."""

    def join(key: tuple, rows):
        ordered = rows.sort_values("place")
        state = merge([pickle.loads(x) for x in ordered["state"]])
        rows = ordered.iloc[:1].copy()
        rows["place"], rows["state"] = int(key[0]), [pickle.dumps(state)]
        return rows

    parts = stored(parts, "states")
    while parts.count() > 1:
        by = F.floor(F.col("place") / FAN).alias("by")
        parts = stored(parts.groupBy(by).applyInPandas(join, STATE), "states")
    row = parts.first()
    return None if row is None else pickle.loads(row["state"])


def exact_sums(state: tuple, x: np.ndarray) -> tuple:
    n, sums = state
    most = int(max(x.max(), -int(x.min()))) if x.size else 0
    fits = most * len(x) < 1 << 62
    new = x.sum(axis=0).tolist() if fits else x.astype(object).sum(axis=0).tolist()
    return n + len(x), [a + b for a, b in zip(sums, new)]


class Model:
    """Mean, falling eigenvalues of positive variance and their unit vectors (columns)."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.sums, self.trace = n, sums, float(values.sum())
        self.mean = np.array([s / n for s in sums])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        good = values > len(sums) * 16 * EPS * max(values.max(initial=0.0), 0.0)
        self.values, self.vectors = values[good], vectors[:, good]
        if self.vectors.size:  # of either sign, the one whose largest entry is positive
            largest = np.abs(self.vectors).argmax(axis=0)
            self.vectors = self.vectors * np.sign(self.vectors[largest, np.arange(len(self.values))])

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        return (x - self.mean) @ self.vectors[:, :components] / np.sqrt(self.values[:components])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n*x - S)^2; null beyond a long."""
        n, sums = self.n, self.sums
        most = max((abs(s) for s in sums), default=0) + n * (int(np.abs(x).max()) if x.size else 0)
        if most * most * max(len(sums), 1) < 1 << 63:
            apart = n * x - np.array(sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = n * x.astype(object) - np.array(sums, object)
        return [d if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]


def summed(states: list) -> np.ndarray:
    return sum(states[1:], states[0])


def fit(distinct: DataFrame, width: int) -> Model | None:
    """The model of distinct x vectors, all of ``width`` entries; None without rows.

    The driver and every task hold matrices of width x width, whatever the number of rows.
    """

    def add(states: list) -> tuple:
        return sum(s[0] for s in states), [sum(column) for column in zip(*[s[1] for s in states])]

    found = total(partial(distinct, exact_sums, lambda: (0, [0] * width)), add)
    if found is None:
        return None
    n, sums = found
    mean = np.array([s / n for s in sums])

    def update(state: tuple, x: np.ndarray) -> tuple:
        for row in x - mean:
            state = rank_one(*state, row)
        return state

    spectra = partial(distinct, update, lambda: (np.zeros(width), np.eye(width)))
    _, basis = total(spectra, merged_spectra)
    basis = np.linalg.qr(basis)[0]

    def project(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        turned = (x - mean) @ basis
        return state + turned.T @ turned

    small = total(partial(distinct, project, lambda: np.zeros((width, width))), summed) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return Model(n, sums, values, basis @ turn)


def identity_error(distinct: DataFrame, model: Model, components: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    size = min(components, len(model.values))

    def cover(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = model.whiten(x, size)
        return state + out.T @ out

    found = total(partial(distinct, cover, lambda: np.zeros((size, size))), summed) / model.n
    return float(np.abs(found - np.eye(size)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every whole vector.

    Rows with a null vector, a null or non-finite entry or one beyond 2^54 are left out.  Vectors shorter
    than the longest are filled with zeros.  Repeated vectors count once in the fit and come back row by
    row, whatever their ids; null ids stay null.  Components without variance have no rows, so equal
    vectors or none at all give an empty result.  A deviation beyond a long is null.  Other columns are
    ignored.
    """
    rows = stored(scaled(vectors, F.col("vec_id").cast("long").alias("vec_id")), "scaled")
    width = rows.agg(F.max(F.size("x")).alias("width")).first()["width"] or 0
    rows = rows.select("vec_id", padded(F.col("x"), width).alias("x"))
    distinct = stored(rows.select("x").distinct().repartition(partitions(rows), "x"), "distinct")
    model = fit(distinct, width) if width else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], OUT)
    error, size = identity_error(distinct, model, components), min(components, len(model.values))
    schema = pa.schema(
        [(name, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind])
         for name, kind in map(str.split, OUT.split(", "))]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids, count = np.repeat(np.arange(batch.num_rows), size), batch.num_rows * size
            deviation = pa.array(model.deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(ids)),
                    pa.array(np.tile(np.arange(1, size + 1), batch.num_rows), pa.int32()),
                    pa.array(np.full(count, model.n)),
                    deviation.take(pa.array(ids)),
                    pa.array(model.whiten(x, size).ravel()),
                    pa.array(np.tile(model.values[:size] / model.trace, batch.num_rows)),
                    pa.array(np.full(count, error)),
                ],
                schema=schema,
            )

    return rows.mapInArrow(project, OUT)
