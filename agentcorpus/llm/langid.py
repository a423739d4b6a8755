"""Operator 9: language ID by multinomial naive Bayes over hashed character n-grams.

Counting is one pass over all labelled texts: each task sums count vectors per language and emits
their non-zero cells.  The log-probability matrix (languages x buckets, whatever the corpus size) is
broadcast, and texts are scored in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
BUCKETS = 1 << BITS
UNKNOWN = "und"
FOLDS = 5
CHUNK = 1 << 19  # characters in numpy at once: bounds memory, never the text
BLANK = 32


def held_out(doc_id: Column) -> Column:
    """Kept from training: crc32 of the id's decimal text modulo 5 is 0.  A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


class _Letters:
    """Which code points are letters, built once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, codes: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x32000)), bool, 0x32000)
        return cls.table[np.minimum(codes, 0x31FFF)]


def blocks(texts: Sequence[str]) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Cut and group texts to blocks of about CHUNK characters: (row of each piece, joined, lengths)."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for start in range(0, len(text), CHUNK):
            part = f" {text[start : start + CHUNK].lower()} "
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield rows, "".join(parts), np.array([len(p) for p in parts])
                rows, parts, size = [], [], 0
    if parts:
        yield rows, "".join(parts), np.array([len(p) for p in parts])


def buckets(joined: str, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hash buckets of the 1-, 2- and 3-grams of letters; the piece of each place; letters by piece.

    Anything but a letter is a blank and runs of blanks are one, so digits, marks and markup say
    nothing.  A gram that would leave its piece gets the bucket BUCKETS, which has no weight.
    """
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    letter = _Letters.of(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (piece[1:] != piece[:-1])
    keep[0] = True
    codes = np.where(letter, codes, BLANK)[keep].astype(np.uint64)
    counts = np.bincount(piece, weights=letter, minlength=len(lengths))
    piece = piece[keep]
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    found, value = [], np.zeros(len(codes), np.uint64)
    for order in range(3):
        value = value[: len(codes) - order] * np.uint64(0x100000001B3) + codes[order:]
        inside = piece[: len(value)] == piece[order:]
        if order == 0:
            inside = codes != BLANK
        hashed = (((value + np.uint64(order + 1)) * mix) >> shift).astype(np.int32)
        hashed[~inside] = BUCKETS
        found.append(hashed)
    return found, piece, counts


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over whole texts; bucket -1 counts the documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(part)
                for _, joined, lengths in blocks(part["text"].tolist()):
                    for hashed in buckets(joined, lengths)[0]:
                        total[:BUCKETS] += np.bincount(hashed, minlength=BUCKETS + 1)[:BUCKETS]
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            places = np.where(used == BUCKETS, -1, used)
            yield pd.DataFrame({"lang": lang, "bucket": places, "n": total[used]})

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counted = rows.mapInPandas(count, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in alphabetical order, log priors, and log probabilities per bucket."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.langs = sorted(counts["lang"].unique())
        order = {lang: k for k, lang in enumerate(self.langs)}
        place = counts["lang"].map(order).to_numpy(np.int64)
        cells = np.zeros((len(self.langs), BUCKETS + 1))
        cells[place, counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        documents = cells[:, BUCKETS]
        self.prior = np.log(documents / documents.sum()) if len(self.langs) else np.zeros(0)
        grams = cells[:, :BUCKETS] + 1.0
        weights = np.log(grams / grams.sum(axis=1, keepdims=True))
        self.weights = np.hstack([weights, np.zeros((len(self.langs), 1))]).astype(np.float32)

    def predict(self, texts: Sequence[str | None]) -> pd.DataFrame:
        whole = [text or "" for text in texts]
        logs = np.zeros((len(whole), len(self.langs)))
        letters = np.zeros(len(whole))
        for rows, joined, lengths in blocks(whole):
            found, piece, counts = buckets(joined, lengths)
            np.add.at(letters, rows, counts)
            starts = np.searchsorted(piece, np.arange(len(lengths)))
            for hashed in found:
                at = np.minimum(starts, max(len(hashed) - 1, 0))
                for k in range(len(self.langs)):
                    values = self.weights[k][hashed]
                    if len(values):
                        sums = np.add.reduceat(values, at, dtype=np.float64)
                        sums[starts >= len(hashed)] = 0
                        np.add.at(logs[:, k], rows, sums)
        known = (letters > 0) & bool(self.langs)
        if not self.langs:
            return pd.DataFrame({"lang": [UNKNOWN] * len(whole), "score": np.zeros(len(whole))})
        logs += self.prior
        best = logs.argmax(axis=1)
        score = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.array(self.langs, dtype=object)[best]
        return pd.DataFrame(
            {"lang": np.where(known, names, UNKNOWN), "score": np.where(known, score, 0.0)}
        )


def fit(docs: DataFrame) -> Model:
    """Learn from all rows with text and lang.  The collected counts are one row per language and
    bucket, so their number depends on the label set alone."""
    return Model(count_grams(docs).toPandas())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` from the text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; else the
    likeliest learned language (a tie: the alphabetically first) and its posterior probability.
    Equal texts get equal answers; other columns pass through, but columns of these two names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield shared.value.predict(batch.tolist())

    return (
        docs.withColumn("_lang", predict("text"))
        .withColumns({"lang_pred": F.col("_lang.lang"), "lang_score": F.col("_lang.score")})
        .drop("_lang")
    )


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold and classify all of them."""
    split = docs.withColumn("_held", held_out(F.col("doc_id")))
    return classify(docs, fit(split.where(~F.col("_held"))))
