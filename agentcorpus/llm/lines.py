"""Operator 1: near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions alone.

Two lines are near when one edit (a character inserted, deleted or replaced) turns one into the
other, after lower case and single blanks.  Deletion variants of whole lines would be as many rows as
characters, so they are emitted only where they can meet: one edit leaves all but one part of a line
as it is, so near lines share an anchor (base length, the hash of what stands before a part and after
it), and only anchors that two different lines share get variants, of the one part between.

Under an anchor, equal variants mean one edit: two lines of the base length that agree after a
deletion at the same place differ by a replacement, and a line one longer that agrees after a
deletion with a whole part differs by an insertion.  Every group of equal variants links its members
to its earliest one, never to each other, and each link's edit distance is verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions.staging import staged
from agentcorpus.llm.store import numbered, stored

LEAST = 16  # shorter lines are compared as they are
PART = 512  # characters of a part of a long line
SPACES = " \t\n\r\f\v"
FIRST = -(1 << 63)
DOC = ["_order", "_hash"]


def normal(line: Column) -> Column:
    """Lower case, white space as single blanks, trimmed.  What few lines need runs only for those."""
    odd = reduce(Column.__or__, [F.contains(line, F.lit(space)) for space in SPACES[1:]])
    lower = F.lower(line)
    plain = F.when(odd, F.translate(lower, SPACES, " " * len(SPACES))).otherwise(lower)
    single = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)
    return F.trim(single)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents by (id, text hash).  Rows equal in both are one document and share its fate."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("_order"),
        F.xxhash64("text").alias("_hash"),
        F.split("text", "\n").alias("_lines"),
    )


def parts(base: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(base / PART).cast("int"))


def bounds(base: Column, part: Column) -> tuple[Column, Column]:
    """Characters before a part, and after it, in a line of the base length."""
    cut = lambda k: F.floor(base.cast("bigint") * k / parts(base)).cast("int")
    return cut(part), base - cut(part + 1)


def anchors(base: Column) -> Column:
    """The anchors of a line for a base length (its own, or one less), one per part."""

    def anchor(part: Column) -> Column:
        before, after = bounds(base, part)
        head = F.substring("_norm", F.lit(1), before)
        tail = F.substring("_norm", F.col("n") - after + 1, after)
        return F.xxhash64(base, part, head, tail)

    return F.transform(F.sequence(F.lit(0), parts(base) - 1), anchor)


def all_lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: its place, its 128-bit key, its length and its anchors."""
    rows = keyed(docs).select(*DOC, F.posexplode("_lines").alias("_pos", "_line"))
    held = staged(rows, {"_norm": normal(F.col("_line"))}).where(F.col("_norm") != "")
    sized = held.withColumn("n", F.char_length("_norm"))
    both = F.concat(anchors(F.col("n")), anchors(F.col("n") - 1))
    return sized.select(
        *DOC,
        "_pos",
        F.xxhash64("_norm").alias("k1"),
        F.xxhash64(F.lit("second"), "_norm").alias("k2"),
        "n",
        F.when(F.col("n") >= LEAST, both).alias("anchors"),
    )


def anchored(lines: DataFrame) -> DataFrame:
    """A row per line and anchor, with the base length and the part."""
    own = parts(F.col("n"))
    rows = lines.select("k1", "k2", "n", F.posexplode("anchors").alias("_at", "anchor"))
    first = F.col("_at") < own
    return rows.select(
        "k1",
        "k2",
        "n",
        F.when(first, F.col("n")).otherwise(F.col("n") - 1).alias("base"),
        F.when(first, F.col("_at")).otherwise(F.col("_at") - own).alias("part"),
        "anchor",
    )


def variants(lines: DataFrame) -> DataFrame:
    """(key, id, center): a row per deletion in the part between, and one for the whole part.

    Lines of the base length put the place of the deletion into the key, and are the center of the
    key that the lines one longer reach by any deletion.
    """
    before, after = bounds(F.col("base"), F.col("part"))
    own = F.col("n") == F.col("base")
    middle = F.substring("_norm", before + 1, F.col("n") - before - after)
    held = staged(lines, {"middle": middle}).where(F.char_length("middle") > 0)

    def deleted(at: Column) -> Column:
        text = F.col("middle")
        rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.char_length(text)))
        return F.xxhash64("anchor", F.when(own, at).otherwise(F.lit(0)), rest)

    places = F.sequence(F.lit(1), F.char_length("middle"))
    whole = F.when(own, F.array(F.xxhash64("anchor", F.lit(0), F.col("middle")))).otherwise(
        F.array().cast("array<bigint>")
    )
    made = held.select(
        "id",
        own.alias("own"),
        F.xxhash64("anchor", F.lit(0), F.col("middle")).alias("_whole"),
        F.array_distinct(F.concat(F.transform(places, deleted), whole)).alias("keys"),
    ).select("id", "own", "_whole", F.explode("keys").alias("key"))
    return made.select("key", "id", (F.col("own") & (F.col("key") == F.col("_whole"))).alias("center"))


def near_lines(docs: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """Keys of the distinct lines that have an earlier line one edit away."""
    shared = stored(
        lines.select("k1", F.explode("anchors").alias("anchor"))
        .groupBy("anchor")
        .agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
        .where("low < high")
        .select("anchor"),
        "anchors",
    )
    # a row per line and shared anchor; equal lines are one
    found = stored(
        anchored(lines).join(shared, "anchor", "left_semi").distinct(), "candidates"
    )
    wanted = (
        found.select("k1", "k2")
        .distinct()
        .join(first, ["k1", "k2"])
        .groupBy("_order", "_hash")
        .agg(F.collect_list(F.struct("k1", "k2", "_pos")).alias("_wanted"))  # a document's own lines
    )
    texts = (
        keyed(docs)
        .join(wanted, DOC)
        .select(*DOC, "_lines", F.explode("_wanted").alias("w"))
        .select(*DOC, "w._pos", "w.k1", "w.k2", normal(F.get("_lines", F.col("w._pos"))).alias("_norm"))
        .dropDuplicates(["k1", "k2"])
    )
    # numbered by first occurrence, so that a smaller id is an earlier line
    texts = stored(
        numbered(texts, [F.col(c) for c in (*DOC, "_pos")], "id").select("id", "k1", "k2", "_norm"),
        "lines",
    )
    spread = stored(variants(found.join(texts, ["k1", "k2"]).drop("k1", "k2")), "variants")
    groups = stored(
        spread.groupBy("key")
        .agg(
            F.min("id").alias("earliest"),
            F.max("id").alias("latest"),
            F.min(F.when(F.col("center"), F.col("id"))).alias("middle_id"),
        )
        .where("earliest < latest")
        .drop("latest"),
        "variant_groups",
    )
    inserted = F.col("middle_id").isNotNull() & ~F.col("center")
    links = (
        spread.join(groups, "key")
        .select("id", F.when(inserted, F.col("middle_id")).otherwise(F.col("earliest")).alias("to"))
        .where("id <> to")
        # of either line, the later goes
        .select(F.greatest("id", "to").alias("id"), F.least("id", "to").alias("to"))
        .distinct()
    )
    earlier = texts.select(F.col("id").alias("to"), F.col("_norm").alias("_other"))
    verified = (
        links.join(texts, "id")
        .join(earlier, "to")
        .where(F.levenshtein("_norm", "_other", 1).between(0, 1))
    )
    return stored(verified.select("k1", "k2").distinct(), "near_lines")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that repeat, or are one edit away from, an earlier line.

    Lines are compared across the corpus and within a document, in the order of (doc_id, line), null
    doc_id first; documents that share an id are ordered by a hash of their text.  A line goes if it
    equals an earlier one after lower case and single blanks, or if it and an earlier line have at
    least LEAST characters and are one edit apart, whether or not that one stays.  Blank lines never
    count as copies, but a document without any other line left gets an empty text.  Null text stays
    null.  Rows that repeat id and text are one document and both keep its lines.

    Adds ``lines_in`` and ``lines_kept`` (without blank ones); columns of these names are replaced.
    """
    lines = stored(all_lines(docs), "all_lines")
    place = F.struct(*DOC, "_pos")
    first = stored(
        lines.groupBy("k1", "k2").agg(F.min(place).alias("first")).select("k1", "k2", "first.*"),
        "first_lines",
    )
    gone = near_lines(docs, lines, first)
    kept = stored(
        first.join(gone, ["k1", "k2"], "left_anti")
        .groupBy(*DOC)
        .agg(F.array_sort(F.collect_list("_pos")).alias("_kept")),  # a document's own lines
        "kept_lines",
    ).select(F.col("_order").alias("_kept_order"), F.col("_hash").alias("_kept_hash"), "_kept")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST))
    joined = docs.join(
        kept,
        (order == F.col("_kept_order")) & (F.xxhash64("text") == F.col("_kept_hash")),
        "left",
    )
    held = staged(joined, {"_split": F.split("text", "\n")})
    blank = F.transform("_split", lambda line, at: F.when(F.trim(line, F.lit(SPACES)) == "", at))
    places = F.array_sort(F.concat(F.col("_kept"), F.array_compact(blank)))
    text = F.when(F.col("_kept").isNull(), F.when(F.col("text").isNotNull(), F.lit(""))).otherwise(
        F.array_join(F.transform(places, lambda at: F.get("_split", at)), "\n")
    )
    total = F.size("_split") - F.size(F.array_compact(blank))
    return held.withColumns(
        {
            "lines_in": F.coalesce(total, F.lit(0)),
            "lines_kept": F.coalesce(F.size("_kept"), F.lit(0)),
            "text": text,
        }
    ).drop("_split", "_kept", "_kept_order", "_kept_hash")
