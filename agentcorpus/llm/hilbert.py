"""Operator 10: shards cut from a Hilbert curve over several metadata dimensions.

Every row gets cells in a few quantised dimensions (language, source, length).  The Hilbert index of
the cells orders the rows so that rows near each other agree in all dimensions at once, and the
ordered rows are cut into runs.  Readers that filter on any of the dimensions skip most files.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.llm.store import numbered, stored

BITS = 5


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state by (state, cell corner), from the rule of the curve.

    A state is (entry corner, axis); the corner is reflected by the entry, rotated by the axis and
    read as a Gray code, whose rank is the digit along the curve.
    """
    corners = 1 << dims

    def rotate(value: int, by: int) -> int:
        by %= dims
        return ((value << by) | (value >> (dims - by))) & (corners - 1)

    def gray(rank: int) -> int:
        return rank ^ (rank >> 1)

    def trailing_ones(rank: int) -> int:
        return 0 if not rank & 1 else 1 + trailing_ones(rank >> 1)

    def entry(rank: int) -> int:
        return 0 if rank == 0 else gray(2 * ((rank - 1) // 2))

    def direction(rank: int) -> int:
        if rank == 0:
            return 0
        return trailing_ones(rank if rank & 1 else rank - 1) % dims

    rank_of = {gray(rank): rank for rank in range(corners)}
    digits, states = [], []
    for start, axis, corner in product(range(corners), range(dims), range(corners)):
        rank = rank_of[rotate(corner ^ start, -(axis + 1))]
        digits.append(rank)
        next_start = start ^ rotate(entry(rank), axis + 1)
        next_axis = (axis + direction(rank) + 1) % dims
        states.append((next_start * dims + next_axis) * corners)
    return digits, states


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of integer cells below ``2 ** bits``."""
    dims = len(cells)
    digits, states = curve_tables(dims)
    digit_of, next_of = (F.array(*map(F.lit, table)) for table in (digits, states))
    state, index = F.lit(0), F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        corner = reduce(
            lambda a, b: a + b,
            [F.shiftright(c, bit).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, c in enumerate(cells)],
        )
        place = state + corner
        index = index * F.lit(1 << dims) + F.get(digit_of, place)
        state = F.get(next_of, place)
    return index


def quantile_cell(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Equal-count cell of a numeric column; the bounds are a fixed-size summary of all rows."""
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(F.percentile_approx(column, steps, 10_000).alias("b")).first()["b"] or []
    value = F.coalesce(F.col(column), F.lit(0))
    return reduce(lambda a, b: a + b, [(value >= F.lit(b)).cast("int") for b in bounds], F.lit(0))


def rank_cell(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Cell of a text column by the rank of its value among the distinct ones, in value order.

    Neighbouring cells hold neighbouring values, so that the least and greatest value of a file tell
    what it holds; few values have a cell each, spread evenly.  Only the bounds between cells reach the driver.
    """
    values = numbered(df.select(column).distinct(), [F.col(column)], "rank")
    total, cells = values.count(), 1 << bits
    ranks = sorted({-(-k * total // cells) for k in range(1, cells)} & set(range(1, total)))
    bounds = [row[column] for row in values.where(F.col("rank").isin(ranks)).select(column).collect()]
    above = [(F.col(column) >= F.lit(b)).cast("int") for b in bounds]
    return reduce(lambda a, b: a + b, above, F.lit(0)) * F.lit(cells // (len(bounds) + 1))


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: its size, its shard and its slot there.

    Law ``rows``: shard sizes differ by one row at most.  Equal texts take the language and source
    of their earliest copy, so that a group lies together on the curve and is only parted where a
    cut falls inside it.  Null text counts as empty; null language, source or doc_id sort first;
    repeated rows each get a slot.  An empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    )
    rows = stored(rows, "sizes")
    groups = rows.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "lang", "source", "size")).alias("first")
    )
    size_cell = quantile_cell(rows, "size")
    cells = {"lang_cell": rank_cell(rows, "lang"), "source_cell": rank_cell(rows, "source"), "cell": size_cell}
    curve = hilbert_index([F.col(name) for name in cells])
    # stored, so that the join below has two plain exchanges and a hot group of copies is split
    groups = stored(
        groups.select("k1", "k2", "first.lang", "first.source", F.col("first.size").alias("size"))
        .withColumns(cells)
        .select("k1", "k2", curve.alias("curve")),
        "groups",
    )
    placed = rows.select("doc_id", "size", "text_crc32", "k1", "k2").join(groups, ["k1", "k2"])
    order = [F.col(c) for c in ("curve", "k1", "k2", "doc_id")]
    ranked = numbered(placed, order)
    total = ranked.count()
    shard = F.expr(f"rn * {shards} div {max(total, 1)}")
    first = F.expr(f"(rn * {shards} div {max(total, 1)} * {total} + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("rn") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write whole documents by shard, in slot order, one folder per shard.

    ``doc_id`` must be unique here.  A shard is written by as many tasks as it has slot ranges.
    """
    slots = assigned.select(F.col("doc_id").alias("_id"), "shard", "slot")
    (
        docs.join(slots, docs["doc_id"].eqNullSafe(slots["_id"]))
        .drop("_id")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
