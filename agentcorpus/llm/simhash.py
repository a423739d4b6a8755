"""Operator 6: SimHash fingerprints of 128 bits, and all pairs of near fingerprints by block tables.

Terms are runs of three words, weighted by how often they occur: every occurrence adds its sign to
every bit.  The 128 tallies are 64 sums, since two 32-bit counts fit in one number, and stay inside
generated code.  Near fingerprints are found through permuted tables: of RADIUS + 2 blocks, at least
two are equal in any two fingerprints within the radius, so there is a table for every two blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentcorpus.llm.store import partitions, stored

RUN = 3
RADIUS = 3
LANES = 0x1_0000_0001
FIRST = -(1 << 63)
ORDER, PLACE = "_order", "_place"


def terms(words: Column) -> Column:
    """Hash of every run of three words; a shorter text is one run, of whatever words it has."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - RUN, F.lit(0)))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(RUN)]))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def tallies(half: int) -> list[Column]:
    """Sums of two bits at a time: bit i in the low lane, bit i + 32 in the high lane."""
    bits = [F.shiftrightunsigned(f"_term{half}", i).bitwiseAND(F.lit(LANES)) for i in range(32)]
    return [F.sum(b).alias(f"_votes{half}_{i}") for i, b in enumerate(bits)]


def signs(half: int) -> Column:
    """The bits that more than half of the term occurrences have set."""
    parts = []
    for i in range(32):
        votes = F.col(f"_votes{half}_{i}")
        low, high = votes.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(votes, 32)
        for count, bit in ((low, i), (high, i + 32)):
            mark = 1 << bit if bit < 63 else FIRST
            parts.append(F.when(count * 2 > F.col("_occurrences"), F.lit(mark)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), [p.cast("bigint") for p in parts])


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per ``keys`` with the fingerprint's halves ``a`` and ``b``.

    Null text counts as empty; texts without words share one fingerprint.  The keys must tell rows
    apart; where the input is already partitioned by some of them, nothing is shuffled.
    """
    split = texts.select(*keys, words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    hashed = split.select(*keys, F.explode(terms(F.col("_words"))).alias("_term0"))
    voted = (
        hashed.withColumn("_term1", F.xxhash64("_term0"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_occurrences"), *tallies(0), *tallies(1))
    )
    return voted.select(*keys, signs(0).alias("a"), signs(1).alias("b"))


def likeness(a: Column, b: Column, other_a: Column, other_b: Column) -> Column:
    """Share of equal bits."""
    apart = F.bit_count(a.bitwiseXOR(other_a)) + F.bit_count(b.bitwiseXOR(other_b))
    return 1.0 - apart / 128.0


def as_text(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def ordered_blocks(docs: DataFrame) -> DataFrame | None:
    """Rows with their block of consecutive ids; a block's first row is also the previous block's
    guest, and the first block's the last one's, so every row meets its successor in its block.

    The blocks are quantiles of the ids, eight for each shuffle partition.
    """
    count = 8 * partitions(docs)
    keyed = docs.withColumn(ORDER, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)))
    steps = [k / count for k in range(1, count)]
    found = keyed.agg(
        F.min(ORDER).alias("low"),
        F.percentile_approx(ORDER, steps, max(10_000, 20 * count)).alias("cuts"),
    ).first()
    if found["low"] is None:
        return None
    bounds = sorted({found["low"], *found["cuts"]})
    listed = F.transform(  # folded to one literal, whatever its length
        F.split(F.lit(",".join(map(str, bounds))), ","), lambda x: x.cast("bigint")
    )
    halvings = [1 << k for k in reversed(range((len(bounds)).bit_length()))]
    block = F.aggregate(  # binary search for the last bound that is not above
        F.array(*map(F.lit, halvings)),
        F.lit(0),
        lambda at, step: F.when(F.get(listed, at + step) <= F.col(ORDER), at + step).otherwise(at),
    )
    blocked = keyed.withColumn("_block", block)
    previous = F.pmod(F.col("_block") - 1, F.lit(len(bounds)))
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(previous.alias("block"), F.lit(True).alias("guest"))
    opens = F.get(listed, F.col("_block")) == F.col(ORDER)
    return blocked.withColumn(
        PLACE, F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own)))
    ).drop("_block")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The edited text has its last half replaced by as much of the next document, in ascending order
    of doc_id, null first; documents that share an id are ordered by a hash of their text, and the
    first follows the last.  A lone document follows itself.  Null text counts as empty.  An empty
    table gives no rows.  Repeated rows each give one.
    """
    blocked = ordered_blocks(
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    )
    names = "doc_id bigint, n_chars bigint, edited_sha256 string, a bigint, b bigint"
    if blocked is None:
        empty = docs.sparkSession.createDataFrame([], names + ", ea bigint, eb bigint, near_next double")
        return empty.withColumn("near_edited", F.lit(0.0))
    placed = blocked.select(
        "doc_id", "text", ORDER, F.xxhash64("text").alias("_tie"), f"{PLACE}.block", f"{PLACE}.guest"
    )
    along = Window.partitionBy("block").orderBy("guest", ORDER, "_tie")
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), size - half), F.col("_next").substr(F.lit(1), half)
    )
    rows = (
        placed.withColumns({"_next": F.lead("text").over(along), "row": F.row_number().over(along)})
        .withColumn("edited", F.when(~F.col("guest"), edited))
        .withColumn("n_chars", size.cast("bigint"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")),
    )
    keys = ["block", "row", "guest", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", "s.text")
    both = both.where(F.col("text").isNotNull())  # guests have no edited text
    marked = fingerprint(both, [*keys, "side"])
    at = lambda side, half: F.max(F.when(F.col("side") == side, F.col(half)))
    joined = marked.groupBy(*keys).agg(
        at(0, "a").alias("a"), at(0, "b").alias("b"), at(1, "a").alias("ea"), at(1, "b").alias("eb")
    )
    line = Window.partitionBy("block").orderBy("row")
    a, b = F.col("a"), F.col("b")
    near = likeness(a, b, F.lead("a").over(line), F.lead("b").over(line))
    return (
        joined.withColumn("near_next", near)
        .where(~F.col("guest"))
        .withColumn("near_edited", likeness(a, b, F.col("ea"), F.col("eb")))
        .drop("block", "row", "guest")
    )


def block_keys(radius: int = RADIUS) -> Column:
    """A key for every two of ``radius + 2`` blocks of the 128 bits."""
    count = radius + 2
    cuts = [128 * k // count for k in range(count + 1)]

    def piece(low: int, high: int) -> list[Column]:
        found = []
        for name, start in (("a", 0), ("b", 64)):
            first, last = max(low, start) - start, min(high, start + 64) - start
            if first < last:
                mask = (1 << (last - first)) - 1
                bits = F.shiftrightunsigned(name, first)
                found.append(bits if mask >= 1 << 63 else bits.bitwiseAND(F.lit(mask)))
        return found

    pieces = [piece(low, high) for low, high in zip(cuts, cuts[1:])]
    return F.array(
        *[F.xxhash64(F.lit(i), F.lit(j), *pieces[i], *pieces[j]) for i, j in combinations(range(count), 2)]
    )


def within_radius(queries: DataFrame, marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, other_a, other_b, apart): for each distinct query fingerprint all distinct
    fingerprints of ``marks`` that differ in at most ``radius`` bits, itself included if there.

    Copies are one fingerprint, so a large group of them is one row here.
    """
    asked = queries.select("a", "b").distinct().withColumn("_key", F.explode(block_keys(radius)))
    there = marks.select("a", "b").distinct().withColumn("_key", F.explode(block_keys(radius)))
    there = there.select("_key", F.col("a").alias("other_a"), F.col("b").alias("other_b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("other_a"))) + F.bit_count(
        F.col("b").bitwiseXOR(F.col("other_b"))
    )
    return (
        asked.join(there, "_key")
        .withColumn("apart", apart)
        .where(F.col("apart") <= radius)
        .select("a", "b", "other_a", "other_b", "apart")
        .distinct()
    )


def count_near(marked: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """Add ``near_docs``: for rows that ``asked`` selects, how many other rows have a fingerprint
    within the radius; null for the rest."""
    copies = marked.groupBy(F.col("a").alias("other_a"), F.col("b").alias("other_b")).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    asked = F.coalesce(asked, F.lit(False))
    queries = marked.where(asked)
    found = (
        within_radius(queries, marked, radius)
        .join(copies, ["other_a", "other_b"])
        .groupBy("a", "b")
        .agg((F.sum("_copies") - 1).alias("near_docs"))
    )
    rest = marked.where(~asked).withColumn("near_docs", F.lit(None).cast("bigint"))
    return queries.join(stored(found, "near"), ["a", "b"]).select(rest.columns).unionByName(rest)
