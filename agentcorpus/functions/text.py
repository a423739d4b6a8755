"""Answer normalisation and token overlap."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
TURN_BOUNDARY = r"(?i)\n(?:user|assistant)\n|<think>|<\|im_(?:start|end)\|>"
ARTICLES = ("a", "an", "the")
# ---------------------------------------------------------------------------------------------

# Characters that compatibility normalisation leaves alone: ASCII and precomposed Latin letters.
# A text made only of these needs no Python round trip.
NORMALISATION_INERT = r"\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to(text: Column, default: str) -> Column:
    """``value or default`` where null and empty text are the same."""
    return F.coalesce(F.when(text != "", text), F.lit(default))


@F.pandas_udf(T.StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text))


def compatibility_form(text: Column) -> Column:
    """NFKC; texts that the form cannot change cross into Python as nulls."""
    affected = F.when(text.rlike(f"[^{NORMALISATION_INERT}]"), text)
    return F.coalesce(_compatibility_form(affected), text)


def answer_tokens(text: Column) -> Column:
    """Lower-case word tokens with punctuation and English articles removed."""
    cleaned = F.regexp_replace(F.lower(compatibility_form(text)), "[^\\p{L}\\p{N}_\\s]", " ")
    return F.filter(
        F.split(cleaned, "\\s+"), lambda token: ~token.isin("", *ARTICLES)
    )


def normalize_answer(text: Column) -> Column:
    return F.concat_ws(" ", answer_tokens(text))


def shared_tokens(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays.

    Both arrays are tagged, sorted together and folded once with a fixed-size state, so long texts
    cost n log n instead of comparing every token with every other.
    """
    tagged = F.array_sort(
        F.concat(
            F.transform(left, lambda t: F.struct(t.alias("t"), F.lit(0).alias("side"))),
            F.transform(right, lambda t: F.struct(t.alias("t"), F.lit(1).alias("side"))),
        )
    )
    empty = F.struct(
        F.lit("").alias("t"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("n")
    )

    def step(acc, item):
        same = acc["t"] == item["t"]
        return F.struct(
            item["t"].alias("t"),
            (F.when(same, acc["l"]).otherwise(F.lit(0)) + (F.lit(1) - item["side"])).alias("l"),
            (F.when(same, acc["r"]).otherwise(F.lit(0)) + item["side"]).alias("r"),
            (
                acc["n"] + F.when(same, F.lit(0)).otherwise(F.least(acc["l"], acc["r"]))
            ).alias("n"),
        )

    return F.aggregate(tagged, empty, step, lambda acc: acc["n"] + F.least(acc["l"], acc["r"]))


def overlap_f1(predicted: Column, expected: Column) -> Column:
    """Token F1 of two token arrays; both empty is 1, one empty is 0."""
    total = F.size(predicted) + F.size(expected)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * shared_tokens(predicted, expected) / F.greatest(total, F.lit(1))
    )


def token_f1(prediction: Column, target: Column) -> Column:
    return overlap_f1(answer_tokens(prediction), answer_tokens(target))


def first_answer(prediction: Column) -> Column:
    """The text before a decoded continuation of the chat."""
    return strip(F.split(prediction, TURN_BOUNDARY, 2)[0])
