"""Operator 8: exact top-k inner products, term at a time.

Candidates and queries are packed into blocks of bounded size.  Candidates are dealt out to tiles once, and
the queries, a small share of the rows, are copied to every tile.  For a pair of blocks every dimension
is a term: its postings (rows and weights of the candidate block) are scattered, times the weights of
the queries that have the term, into dense score arrays.  Partition selection keeps each query's best
of the block, and the bests of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentcorpus.llm.store import stored

CANDIDATES = 4096
QUERIES = 256
TILE = 16  # candidate blocks in a tile
SCALE = 256
BLOCK = "n int, kind string, ids binary, weights binary"
NAMES = [field.split()[0] for field in BLOCK.split(", ")]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components; of rows with one id, the least vector."""
    finite = ~F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Pack rows to blocks of at most ``size`` integer vectors, ids ascending; shorter vectors are
    filled with zeros.  Weights are stored in the narrowest integers that hold them."""

    def packed(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("vec_id")
        width = max(map(len, rows["embedding"]), default=0)
        weights = np.zeros((len(rows), width), np.int64)
        for at, vector in enumerate(rows["embedding"]):
            weights[at, : len(vector)] = np.floor(SCALE * np.asarray(vector, np.float64))
        least, most = weights.min(initial=0), weights.max(initial=0)
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
        ids = rows["vec_id"].to_numpy(np.int64).tobytes()
        return len(rows), kind, ids, weights.astype(kind).tobytes()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            while len(batch):
                part, batch = batch.iloc[: size - count], batch.iloc[size - count :]
                kept.append(part)
                count += len(part)
                if count == size:
                    yield pd.DataFrame([packed(pd.concat(kept))], columns=NAMES)
                    kept, count = [], 0
        if count:
            yield pd.DataFrame([packed(pd.concat(kept))], columns=NAMES)

    return vectors.select("vec_id", "embedding").mapInPandas(pack, BLOCK)


def unpack(n: int, kind: str, ids: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(weights, kind).reshape(n, -1).astype(np.int64)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, one term (dimension) at a time over its non-zero postings."""
    total = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        asked, posted = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        products = np.multiply.outer(queries[asked, term], candidates[posted, term])
        if len(posted) == len(candidates) and len(asked) == len(queries):
            total += products
        elif len(posted) == len(candidates):
            total[asked] += products
        else:
            total[np.ix_(asked, posted)] += products
    return total


def best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values; of equal ones at the border, the first places."""
    if len(row) <= k:
        return np.arange(len(row))
    border = np.partition(row, len(row) - k)[len(row) - k]
    above = np.flatnonzero(row > border)
    return np.concatenate([above, np.flatnonzero(row == border)[: k - len(above)]])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller id.

    A query's own row is no candidate.  Rows with a null id, a null vector or a null or non-finite
    component take no part; rows that repeat an id count once.  Fewer than k candidates give fewer
    rows, no candidates or queries none.  Other columns are ignored.
    """
    asked = usable(queries)
    count = asked.count()
    parts = max(1, -(-count // QUERIES))
    asked = stored(blocks(asked.repartition(parts, "vec_id"), QUERIES), "queries")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in NAMES])
    posted = stored(blocks(usable(candidates), CANDIDATES), "postings")
    tiles = max(1, -(-posted.count() // TILE))
    posted = posted.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                query_ids, wanted = unpack(row.q_n, row.q_kind, row.q_ids, row.q_weights)
                ids, weights = unpack(row.n, row.kind, row.ids, row.weights)
                found = scores(wanted, weights)
                out = []
                for at, query in enumerate(query_ids):
                    places = best(found[at], k + 1)
                    places = places[ids[places] != query]
                    out.append(
                        pd.DataFrame(
                            {"query_id": query, "vec_id": ids[places], "score": found[at][places]}
                        )
                    )
                yield pd.concat(out)

    pairs = posted.join(asked, "tile").drop("tile")
    found = pairs.mapInPandas(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
