"""Operator 11: what document filters remove, alone and after one another.

Documents become a sparse document-term matrix: shards of bounded size hold rows in compressed form
(row ends, term numbers, counts), and one dictionary numbers the words of all shards.  Row sums (words)
and non-zero counts (distinct words) decide the word filters A and B; the character filters C and D and
the copy filter E are attached, and counts per combination of failed filters are expanded to all orders.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from agentcorpus.llm.store import looked_up, partitions, stored, text_key

FILTERS = "ABCDE"
LEAST_WORDS = 100  # A
LEAST_DISTINCT = 80  # B: distinct words in a hundred
MOST_CAPITALS = 10  # C: capitals in a hundred characters
MARKS = b"#$%&*|"  # D
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that continue a character in UTF-8
ENTRIES = 1 << 20  # non-zero entries after which a shard is closed
CARRIED = "doc_id long, part string, fails_c boolean, fails_d boolean, a long, b long"
ROWS = [name.split() for name in CARRIED.split(", ")]
SHARD = ", ".join(f"{name} array<{kind}>" for name, kind in ROWS)
LOCAL = f"shard long, {SHARD}, ends binary, terms binary, counts binary, vocabulary array<binary>"
ENTRY = "part int, shard long, place int, term long, word binary"
MATRIX = f"shard long, {SHARD}, ends binary, terms binary, counts binary"
TOTALS = f"shard long, place long, {CARRIED}, words long, distinct long"
TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
LISTS = [(name, pa.list_(TYPES[kind])) for name, kind in ROWS]
BYTES = [(name, pa.binary()) for name in ("ends", "terms", "counts")]


class Shard:
    """Rows of a document-term matrix whose terms are numbered by first use."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.vocabulary: dict[bytes, int] = {}
        self.ends, self.terms, self.counts = [0], [], []

    def add(self, row: tuple, text: bytes) -> None:
        found = Counter(text.split())  # bytes split at blanks and the controls from tab to return
        numbers = self.vocabulary
        self.rows.append(row)
        self.terms.extend([numbers.setdefault(word, len(numbers)) for word in found])
        self.counts.extend(found.values())
        self.ends.append(len(self.terms))

    def batch(self, number: int) -> pa.RecordBatch:
        lists = [list(column) for column in zip(*self.rows)]
        packed = [np.asarray(x, np.int32).tobytes() for x in (self.ends, self.terms)]
        counts = np.asarray(self.counts, np.int64)
        packed.append(counts.astype(np.min_scalar_type(counts.max(initial=0))).tobytes())
        schema = pa.schema([("shard", pa.int64()), *LISTS, *BYTES, ("vocabulary", pa.list_(pa.binary()))])
        values = [[number], *[[x] for x in lists], *[[x] for x in packed], [list(self.vocabulary)]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, field.type) for x, field in zip(values, schema)], schema=schema
        )


def counted(packed: bytes, size: int) -> np.ndarray:
    """Packed counts: unsigned integers of the least width that holds them."""
    return np.frombuffer(packed, f"u{len(packed) // size if size else 1}")


def characters(text: bytes) -> tuple[bool, bool]:
    """Whether the text fails the character filters C and D."""
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    return 100 * capitals > MOST_CAPITALS * points, len(text.translate(None, MARKS)) < len(text)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of at most ENTRIES entries and one document more."""
    number, shard = TaskContext.get().partitionId() << 32, Shard()
    for batch in batches:
        rows = zip(*[batch.column(name).to_pylist() for name in ("doc_id", "part", "a", "b")])
        for (doc_id, part, a, b), text in zip(rows, batch.column("text")):
            whole = text.as_py()
            shard.add((doc_id, part, *characters(whole), a, b), whole)
            if len(shard.terms) >= ENTRIES or len(shard.rows) >= ENTRIES:
                yield shard.batch(number)
                number, shard = number + 1, Shard()
    if shard.rows:
        yield shard.batch(number)


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct words of a sorted partition from 0; the first row of a word keeps it."""
    part, last, before = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        size, words = batch.num_rows, batch.column("word")
        if size == 0:
            continue
        new = np.ones(size, bool)
        new[0] = words[0].as_py() != last
        new[1:] = pc.not_equal(words.slice(1), words.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        terms = before + np.cumsum(new)
        last, before = words[size - 1].as_py(), int(terms[-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, part, np.int32)),
                batch.column("shard"),
                batch.column("place"),
                pa.array(terms),
                pc.if_else(pa.array(new), words, pa.scalar(None, pa.binary())),
            ],
            names=["part", "shard", "place", "term", "word"],
        )


def encode(shard: pa.Table, entries: pa.Table) -> pa.Table:
    """Replace a shard's own term numbers by those of the dictionary, rows in ascending order."""
    numbers = np.empty(entries.num_rows, np.int64)
    numbers[entries.column("place").to_numpy()] = entries.column("term").to_numpy()
    ends, terms = (np.frombuffer(shard.column(name)[0].as_py(), np.int32) for name in ("ends", "terms"))
    counts = counted(shard.column("counts")[0].as_py(), len(terms))
    terms = numbers[terms]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((terms, owner))
    packed = [ends.tobytes(), terms[order].tobytes(), counts[order].tobytes()]
    kept = [shard.column(name) for name in ("shard", *[name for name, _ in ROWS])]
    return pa.Table.from_arrays(
        [*kept, *[pa.array([x], pa.binary()) for x in packed]],
        schema=pa.schema([("shard", pa.int64()), *LISTS, *BYTES]),
    )


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and non-zero counts of shards, a row per document."""
    names = [name for name, _ in ROWS]
    schema = pa.schema(
        [("shard", pa.int64()), ("place", pa.int64()), *[(n, TYPES[k]) for n, k in ROWS]]
        + [("words", pa.int64()), ("distinct", pa.int64())]
    )
    for batch in batches:
        for at in range(batch.num_rows):
            ends = np.frombuffer(batch.column("ends")[at].as_py(), np.int32)
            counts = counted(batch.column("counts")[at].as_py(), ends[-1])
            until = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            size = len(ends) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, batch.column("shard")[at].as_py())),
                    pa.array(np.arange(size)),
                    *[batch.column(name)[at].values for name in names],
                    pa.array(until[ends[1:]] - until[ends[:-1]]),
                    pa.array(np.diff(ends).astype(np.int64)),
                ],
                schema=schema,
            )


def document_terms(docs: DataFrame, words: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary): the document-term matrix of whole texts in shards, and (word, term).

    A shard's row lists its documents (doc_id, part, flags of C and D, text key) and holds ``ends`` as
    32-bit and ``terms`` as 64-bit integers and ``counts`` as :func:`counted` reads them.  Without
    ``words`` terms are numbered all the same, but the dictionary is not kept and is empty.

    A word is a maximal run of characters other than the blank and the controls 9 to 13; terms number
    the distinct words from 0.  A word comes once from a shard, so even one that all documents share
    is no hot key of the shuffle by word.  Very long texts are read whole; one is never parted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = text_key(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        key["a"].alias("a"),
        key["b"].alias("b"),
        text.cast("binary").alias("text"),
    )
    local = stored(rows.mapInArrow(build, LOCAL), "shards", codec="zstd")
    used = local.select("shard", F.posexplode("vocabulary").alias("place", "word"))
    dealt = used.repartition(partitions(docs), "word").sortWithinPartitions("word")
    entries = dealt.mapInArrow(number, ENTRY)
    if not words:
        entries = entries.withColumn("word", F.lit(None).cast("binary"))
    entries = stored(entries, "entries")
    earlier = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        entries.groupBy("part")  # one row per shuffle partition
        .agg(F.max("term").alias("last"))
        .select("part", F.coalesce(F.sum(F.col("last") + 1).over(earlier), F.lit(0)).alias("before"))
    )
    entries = entries.join(F.broadcast(offsets), "part").withColumn("term", F.col("term") + F.col("before"))
    dictionary = entries.where(F.col("word").isNotNull()).select("word", "term")
    numbers = entries.select("shard", "place", "term").groupBy("shard")
    matrix = local.drop("vocabulary").groupBy("shard").cogroup(numbers).applyInArrow(encode, MATRIX)
    return matrix, dictionary


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, words, distinct, fails): a row per document, ``fails`` naming its failed filters.

    Null texts count as empty, null languages as the empty part.  Of a document without an id E holds
    never, and such documents make no other a copy; rows that repeat an id are no copies of each other.
    """
    rows = stored(document_terms(docs, words=False)[0].mapInArrow(totals, TOTALS), "totals")
    firsts = (
        rows.groupBy("a", "b")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    judged = looked_up(rows, firsts, ["a", "b"], F.xxhash64("shard", "place"))
    failed = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        "C": F.col("fails_c"),
        "D": F.col("fails_d"),
        "E": F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)),
    }
    letters = [F.when(failed[letter], F.lit(letter)).otherwise(F.lit("")) for letter in FILTERS]
    return judged.select(
        "shard", "place", "doc_id", "part", "words", "distinct", F.concat(*letters).alias("fails")
    )


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long")))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of a part's documents at every step of every order of the five filters.

    A document of several label rows is good or toxic if one of them says so; null labels say nothing.
    Extra columns are ignored, and an empty table has no parts and thus no rows.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = looked_up(failures(docs), marks, ["doc_id"], F.xxhash64("shard", "place"))
    good, toxic = (F.coalesce(F.col(name), F.lit(False)).alias(name) for name in ("good", "toxic"))
    kinds = rows.groupBy("part", "fails", good, toxic).agg(F.count(F.lit(1)).alias("n"))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = kinds.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("letter", letter)
    own = F.contains("fails", "letter")
    gone = F.call_function("translate", F.col("fails"), before, F.lit("")) != F.col("fails")
    steps = steps.withColumns({"own": own, "gone": gone})
    own, gone = F.col("own"), F.col("gone")
    counts = steps.groupBy("part", "filter_order", "step", "letter").agg(
        count_where(~own & ~gone).alias("kept"),
        count_where(own & ~gone).alias("removed"),
        count_where(own & gone).alias("redundant"),
        count_where(F.col("fails") == F.col("letter")).alias("unique_fails"),
        count_where(own & ~gone & F.col("good")).alias("good_lost"),
        count_where(own & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    same = W.partitionBy("part", "letter")  # 120 rows
    return counts.withColumn("shapley", F.sum("removed").over(same)).drop("letter")
