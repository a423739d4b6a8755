"""Operator 4: best-fit packing by length patterns and non-negative least squares.

Documents become token pieces of at most ``WIDTH`` tokens.  Packing needs only the histogram of
piece lengths, which has WIDTH bins however large the corpus is: patterns of two or three lengths
that fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded, and what is left is packed best-fit by whole length classes.  The plan is
then applied to the pieces by their rank within the length.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentcorpus.llm.store import numbered, stored

WIDTH = 2048
END = 0
ADDED = {"<|endoftext|>": 50256}  # added tokens of byte_bpe_50k.json, which its merge ranks lack
STEP = 32  # grid of the shortest length in patterns of three
ROUNDS = 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes; an added token in a text is one id.

    A ``.json`` file is read by tokenizers.  A ``.tiktoken`` file holds the same vocabulary as merge
    ranks and, with the added tokens, gives the same ids (tested over the whole tables) at a third of
    the time.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            made = tiktoken.Encoding(
                os.path.basename(path),
                pat_str=public_tokenizers.PATTERN,
                mergeable_ranks=ranks,
                special_tokens=ADDED,
            )
            self.ids = lambda text: made.encode(text, allowed_special="all")
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            self.ids = lambda text: made.encode(text, add_special_tokens=False).ids

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One encoder per path and worker."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype="<u4").tobytes()


def cut_lengths(tokens: int, width: int = WIDTH) -> list[int]:
    """A short first piece where the length is no multiple of the width, then full ones."""
    head = tokens % width
    return [head] * (head > 0) + [width] * (tokens // width)


def token_pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH, ids: bool = False) -> DataFrame:
    """One row per piece, with its place in the document and the checksum of its ids.

    Null text counts as empty: one piece that holds the end token alone.  With ``ids`` the rows
    carry the token ids as binary little-endian 32-bit numbers.
    """

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.at(tokenizer), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = encoder.encode(text or "") + end
                start = 0
                for piece, length in enumerate(cut_lengths(len(data) // 4, width)):
                    part = data[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(part))
                    rows.append((*row, part) if ids else row)
                    start += length
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"doc_id": "Int64"}) if len(frame) else frame

    schema = PIECES + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(tokenize, schema)


def patterns(width: int = WIDTH) -> np.ndarray:
    """Length triples that fill a sequence; a missing third length is 0."""
    low = np.arange(1, width // 2 + 1)
    found = [np.stack([low, width - low, np.zeros_like(low)], axis=1)]
    for least in range(1, width // 3 + 1, max(1, STEP * width // WIDTH)):
        middle = np.arange(least, (width - least) // 2 + 1)
        found.append(np.stack([np.full_like(middle, least), middle, width - least - middle], axis=1))
    return np.concatenate(found)


def fit_repeats(counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of pattern repeats against the histogram (accelerated projected
    gradient; every pattern touches at most three bins)."""
    bins = patterns(width)
    bins = bins[((counts[bins] > 0) | (bins == 0)).all(axis=1)]
    filled = bins > 0
    target = counts.astype(float)
    scale = max(target.max(), 1.0)
    target = target / scale
    # the bound on the curvature: the most a pattern's bins share with all patterns
    load = np.bincount(bins[filled], minlength=width + 1)
    rate = 1.0 / max((load[bins] * filled).sum(axis=1).max(initial=1), 1)
    x = np.zeros(len(bins))
    ahead, momentum = x, 1.0
    for _ in range(ROUNDS):
        covered = np.bincount(
            bins[filled], weights=np.repeat(ahead, filled.sum(axis=1)), minlength=width + 1
        )
        short = target - covered
        short[0] = 0
        following = np.maximum(ahead + rate * short[bins].sum(axis=1), 0)
        next_momentum = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = following + (momentum - 1) / next_momentum * (following - x)
        x, momentum = following, next_momentum
    return bins, x * scale


def best_fit(counts: np.ndarray, width: int = WIDTH) -> list[tuple[Counter, int]]:
    """Best-fit decreasing over length classes: (lengths in a sequence, number of sequences).

    Equal sequences are one class, so the work depends on the number of lengths, not of pieces.
    """
    open_by_room: dict[int, list[tuple[Counter, int]]] = {}
    room_count = np.zeros(width + 1, np.int64)
    for length in range(width, 0, -1):
        left = int(counts[length])
        while left:
            rooms = np.flatnonzero(room_count[length:])
            if not len(rooms):
                each = min(width // length, left)
                times = left // each
                room = width - each * length
                open_by_room.setdefault(room, []).append((Counter({length: each}), times))
                room_count[room] += times
                left -= each * times
                continue
            room = int(rooms[0]) + length
            content, times = open_by_room[room].pop()
            used = min(times, left)
            if used < times:
                open_by_room[room].append((content, times - used))
            open_by_room.setdefault(room - length, []).append((content + Counter({length: 1}), used))
            room_count[room] -= used
            room_count[room - length] += used
            left -= used
    return [found for group in open_by_room.values() for found in group]


def plan(counts: np.ndarray, width: int = WIDTH) -> list[tuple[Counter, int]]:
    """Patterns with repeat counts that use every piece once."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[Counter, int]] = []
    bins, repeats = fit_repeats(left, width)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 0.5:
            break
        content = Counter(int(v) for v in bins[k] if v)
        times = min(int(round(repeats[k])), *(int(left[v]) // n for v, n in content.items()))
        if times > 0:
            chosen.append((content, times))
            for v, n in content.items():
                left[v] -= n * times
    return chosen + best_fit(left, width)


def plan_rows(chosen: list[tuple[Counter, int]]) -> list[tuple]:
    """Per length: rank intervals with their first sequence, copies per sequence and offset."""
    used: Counter = Counter()
    by_length: dict[int, list[tuple]] = {}
    sequence = 0
    for content, times in chosen:
        offset = 0
        for length, copies in sorted(content.items(), reverse=True):
            low = used[length]
            used[length] += copies * times
            by_length.setdefault(length, []).append((low, used[length], sequence, copies, offset))
            offset += length * copies
        sequence += times
    return sorted(by_length.items())


def pack(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``width``.

    Every piece gets one place, sequences are filled without gaps from 0.  Repeated rows are
    separate pieces.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = np.zeros(width + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``width`` rows
        counts[row["length"]] = row["count"]
    before = np.cumsum(counts) - counts
    rows = [(length, int(before[length]), slots) for length, slots in plan_rows(plan(counts, width))]
    slot = "struct<low:bigint,high:bigint,sequence:bigint,copies:bigint,place:bigint>"
    slots = spark.createDataFrame(rows, f"_length bigint, _before bigint, _slots array<{slot}>")
    order = [F.col(c) for c in ("length", "doc_id", "piece")]
    rank = F.col("rn") - F.col("_before")
    at = F.col("_slot")
    within = F.col("_rank") - at["low"]
    return (
        numbered(pieces, order)
        .join(F.broadcast(slots), F.col("length") == F.col("_length"))  # bounded by the patterns
        .withColumn("_rank", rank)
        .withColumn(
            "_slot",
            F.get(
                F.filter(
                    "_slots", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["high"])
                ),
                F.lit(0),
            ),
        )
        .withColumn("sequence_id", at["sequence"] + F.floor(within / at["copies"]).cast("bigint"))
        .withColumn("offset", at["place"] + within % at["copies"] * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, width: int = WIDTH) -> DataFrame:
    """Tokenize whole documents and place their pieces in as few sequences as possible."""
    return pack(stored(token_pieces(docs, tokenizer, width), "pieces"), width)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from packed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate(
            "parts", F.lit(b"").cast("binary"), lambda whole, part: F.concat(whole, part["ids"])
        ).alias("ids"),
    )
