"""Operator 7: licence scans by a trained paragraph classifier.

A paragraph is a run of lines with words, comment marks aside; it is read in overlapping windows that
cross line ends, and its short lines one by one too.  A multinomial logistic regression over hashed word 1- and 2-grams names the licence
family of a window or the class ``unknown``, its probabilities calibrated on held-out examples.  Where a
family is likely enough, the paragraph around the window is compared with the templates of all
families, and the best matches confirm what it is.  The model is trained here: on the templates, whole
and in pieces, alone and amid words of the corpus, against a bounded sample of the corpus's own lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus.llm.words import mix, word_hashes

UNKNOWN = "unknown"
BITS = 15
WINDOW, STEP = 24, 12  # words
NEGATIVES = 3000  # lines sampled from the corpus for training, whatever its size,
NEGATIVE_CHARS = 2000  # and the characters read of each
LEAST_PROBABILITY = 0.1  # of the likeliest family; the templates decide between it and unknown
LEAST_OVERLAP = 0.6  # of a template's word pairs, found in the paragraph
BLOCK = 1 << 20  # bytes read at once
DRAW_BITS = 16  # of the hashes in the histogram that finds the training sample
ROUNDS = 120

# ---- fixed values: customary notices, by family ------------------------------------------------
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license",
        "you may not use this file except in compliance with the License. You may obtain a copy of the"
        " License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except"
        " in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation;"
        " either version 2 of the License, or (at your option) any later version",
        "This program is free software; you can redistribute it and/or modify it under the terms of the"
        " GNU General Public License as published by the Free Software Foundation; either version 2 of"
        " the License, or (at your option) any later version.",
        "Released under the GPL v2",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        " GNU General Public License as published by the Free Software Foundation, either version 3 of"
        " the License, or (at your option) any later version.",
        "Released under the GPL v3",
    ),
    "LGPL": (
        "licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software"
        " Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the"
        " GNU Lesser General Public License as published by the Free Software Foundation; either version"
        " 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software"
        " Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        " GNU Affero General Public License as published by the Free Software Foundation, either version"
        " 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD License",
        "Licensed under the 3-clause BSD license",
        "Licensed under the 2-clause BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    "ISC": (
        "Released under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License",
        "made available under the terms of the Eclipse Public License",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0",
        "dedicated to the public domain under the Creative Commons CC0 1.0 Universal license",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior"
        " written permission of the publisher",
    ),
}
# lines with one of these are no examples of the class unknown
LICENCE_WORDS = "licen[sc]e|licensed|copyright|permission|warranty|public domain|rights reserved|gnu|creative commons"
# ------------------------------------------------------------------------------------------------

KEPT = np.array([32] * 256, np.uint8)
KEPT[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("-"), ord("+"), 10]] = [
    *range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("-"), ord("+"), 10,
]
KEPT[128:] = np.arange(128, 256)
TABLE = KEPT.tobytes()
HYPHENS = re.compile(rb"^ *-+(?= |$)", re.M)  # the other comment marks are no words


def clean(text: str) -> bytes:
    """Lower-case words of letters, digits, - and +; line ends stay, comment marks go."""
    return HYPHENS.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(TABLE))


class Windows:
    """Windows of the paragraphs of some texts, as arrays.

    ``text``, ``first`` and ``size`` (words), ``begin`` and ``end`` (of the paragraph) by window;
    ``single`` and ``pair`` hold the feature of each word and of each word with its successor, -1 at the
    end of a paragraph.
    """

    def __init__(self, texts: Sequence[bytes]) -> None:
        lines = [line for text in texts for line in text.split(b"\n")]
        per_text = np.array([text.count(b"\n") + 1 for text in texts], np.int64)
        self.words, counts = word_hashes(lines) if lines else (np.zeros(0, np.uint64), np.zeros(0, int))
        text_of_line = np.repeat(np.arange(len(texts)), per_text)
        self.line_ends = np.cumsum(counts)
        self.first_line = np.cumsum(per_text) - per_text
        filled = np.flatnonzero(counts)  # a line goes on with the one right before it
        new = np.ones(len(filled), bool)
        new[1:] = (np.diff(filled) > 1) | (np.diff(text_of_line[filled]) > 0)
        opens = filled[new]
        starts = self.line_ends[opens] - counts[opens]
        ends = np.append(starts[1:], len(self.words)) if len(starts) else starts
        each = np.maximum(-(-(ends - starts - WINDOW) // STEP), 0) + 1
        of = np.repeat(np.arange(len(starts)), each)
        number = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        first = starts[of] + number * STEP
        size = np.minimum(WINDOW, ends[of] - first)
        # a short line of a longer paragraph is a window too: a notice may be a line amid others
        holder = np.cumsum(new) - 1
        short = (counts[filled] < WINDOW) & (counts[filled] < (ends - starts)[holder])
        of = np.concatenate([of, holder[short]])
        self.first = np.concatenate([first, (self.line_ends - counts)[filled[short]]])
        self.size = np.concatenate([size, counts[filled[short]]])
        self.begin, self.end = starts[of], ends[of]
        self.text = text_of_line[opens][of]
        shift = np.uint64(64 - BITS)
        self.single = (mix(self.words + np.uint64(1)) >> shift).astype(np.int64)
        after = np.append(self.words[1:], np.uint64(0))
        self.pairs = mix(self.words * np.uint64(3) + mix(after))
        self.pair = (self.pairs >> shift).astype(np.int64)
        self.pair[ends - 1] = -1

    def line(self, word: int, text: int) -> int:
        """Line of a word in its text, from 0."""
        return int(np.searchsorted(self.line_ends, word, side="right")) - int(self.first_line[text])

    def __len__(self) -> int:
        return len(self.first)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Summed feature weights of each window, over the root of its words."""
        values = weights[self.single]
        paired = self.pair >= 0
        values[paired] += weights[self.pair[paired]]
        running = np.vstack([np.zeros((1, weights.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
        last = self.first + self.size
        total = running[last] - running[self.first]
        # a pair whose second word is beyond the window is not in it
        outer = self.pair[last - 1]
        total -= np.where((outer >= 0)[:, None], weights[outer], 0)
        return total / np.sqrt(self.size)[:, None]

    def transpose(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features in order, where each begins, and the windows that hold them."""
        places = np.repeat(np.arange(len(self)), self.size)
        offset = np.arange(len(places)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        at = self.first[places] + offset
        inner = (offset < self.size[places] - 1) & (self.pair[at] >= 0)
        features = np.concatenate([self.single[at], self.pair[at[inner]]])
        order = np.argsort(features, kind="stable")
        found, begins = np.unique(features[order], return_index=True)
        return found, begins, np.concatenate([places, places[inner]])[order]


class Templates:
    """Word pairs of all templates, to be found together."""

    def __init__(self) -> None:
        self.family, each = [], []
        for name, group in TEMPLATES.items():
            for template in group:
                windows = Windows([clean(template)])
                self.family.append(name)
                each.append(windows.pairs[: len(windows.words) - 1])
        self.length = np.array([len(pairs) + 1 for pairs in each])
        self.own = [np.unique(pairs) for pairs in each]
        self.size = np.array([len(pairs) for pairs in self.own])
        owner = np.repeat(np.arange(len(self.own)), self.size)
        order = np.argsort(np.concatenate(self.own), kind="stable")
        self.pairs, self.owner = np.concatenate(self.own)[order], owner[order]
        self.longest = int(self.length.max())

    def matches(self, pairs: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, overlap, first, last) of the templates that the pairs hold enough of, the best
        first; of matches that lie upon one another the better one."""
        low, high = (np.searchsorted(self.pairs, np.unique(pairs), side=side) for side in ("left", "right"))
        low, count = low[high > low], (high - low)[high > low]
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        share = np.bincount(self.owner[at], minlength=len(self.size)) / self.size
        found, taken = [], np.zeros(len(pairs) + 1, bool)
        for k in sorted(np.flatnonzero(share >= LEAST_OVERLAP), key=lambda k: (-share[k], -self.size[k])):
            hit = np.concatenate(([0], np.cumsum(np.isin(pairs, self.own[k]))))
            span = min(int(self.length[k]) + 4, len(pairs))
            first = int((hit[span:] - hit[:-span]).argmax()) if span else 0
            inside = first + np.flatnonzero(np.diff(hit[first : first + span + 1]))
            overlap = len(np.intersect1d(pairs[inside], self.own[k])) / self.size[k]
            if overlap >= LEAST_OVERLAP and taken[inside].mean() <= 0.5:
                taken[inside] = True
                found.append((int(k), overlap, int(inside[0]), int(inside[-1])))
        return found


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, negatives: Sequence[str]) -> None:
        self.names = [UNKNOWN, *TEMPLATES]
        texts, labels = examples(negatives)
        held = np.arange(len(texts)) % 5 == 0
        self.weights = np.zeros((1 << BITS, len(self.names)))
        self.bias = np.zeros(len(self.names))
        self.heat = 1.0
        self._train([t for t, h in zip(texts, held) if not h], labels[~held])
        self._calibrate([t for t, h in zip(texts, held) if h], labels[held])
        self.weights = self.weights.astype(np.float32)
        self.templates = Templates()

    def logits(self, windows: Windows) -> np.ndarray:
        return windows.sums(self.weights) + self.bias

    def _train(self, texts: list[str], labels: np.ndarray) -> None:
        windows = Windows([clean(t) for t in texts])
        target = np.eye(len(self.names))[labels[windows.text]]
        used, begins, holders = windows.transpose()
        rate, memory = 0.5, np.full((len(used), len(self.names)), 1e-8)
        bias_memory = np.full(self.bias.shape, 1e-8)
        for _ in range(ROUNDS):  # full-batch gradient, steps scaled by each weight's history
            errors = (softmax(self.logits(windows)) - target) / len(windows)
            scaled = errors / np.sqrt(windows.size)[:, None]
            slope = np.add.reduceat(scaled[holders], begins) + 1e-7 * self.weights[used]
            memory += slope**2
            self.weights[used] -= rate * slope / np.sqrt(memory)
            bias_memory += errors.sum(axis=0) ** 2
            self.bias -= rate * errors.sum(axis=0) / np.sqrt(bias_memory)

    def _calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        """The temperature under which held-out examples are likeliest."""
        windows = Windows([clean(t) for t in texts])
        logits, wanted = self.logits(windows), labels[windows.text]
        every = np.arange(len(windows))

        def loss(heat: float) -> float:
            return -np.log(softmax(logits / heat)[every, wanted] + 1e-12).mean()

        self.heat = min(np.geomspace(0.25, 8, 41), key=loss)

    def scan(self, texts: Sequence[str]) -> pd.DataFrame:
        """(text, line, family, probability, overlap) of the matches near windows that a family is
        seen in, and of such windows without any, which have overlap 0."""
        windows = Windows([clean(t) for t in texts])
        rows = []
        if len(windows):
            chances = softmax(self.logits(windows) / self.heat)
            best = chances[:, 1:].argmax(axis=1) + 1
            seen = np.flatnonzero(chances[np.arange(len(best)), best] >= LEAST_PROBABILITY)
            reach = self.templates.longest
            for at in seen:
                # the part of the paragraph that a template met by the window can lie in
                begin = max(windows.begin[at], windows.first[at] - reach)
                end = min(windows.end[at], windows.first[at] + windows.size[at] + reach)
                text, found = windows.text[at], self.templates.matches(windows.pairs[begin : end - 1])
                for template, overlap, first, _ in found:
                    name = self.templates.family[template]
                    chance = chances[at, self.names.index(name)]
                    rows.append((text, windows.line(begin + first, text), name, chance, overlap))
                if not found:
                    line = windows.line(windows.first[at], text)
                    rows.append((text, line, self.names[best[at]], chances[at, best[at]], 0.0))
        return pd.DataFrame(rows, columns=["text", "line", "family", "probability", "overlap"])


def examples(negatives: Sequence[str], seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Labelled texts: templates, their pieces, and both amid words of the corpus; plain lines."""
    draw = np.random.default_rng(seed)
    plain = [n for n in negatives if n.strip()] or ["nothing to see here"]
    texts, labels = [], []
    for label, group in enumerate(TEMPLATES.values(), 1):
        for template in group:
            words = template.split()
            for turn in range(60):
                kept = words
                if turn % 4 == 1 and len(words) > 8:  # a long piece
                    size = int(draw.integers(max(6, len(words) // 2), len(words) + 1))
                    start = int(draw.integers(0, len(words) - size + 1))
                    kept = words[start : start + size]
                if turn % 3:
                    around = plain[int(draw.integers(len(plain)))].split()
                    room = max(0, WINDOW - len(kept))
                    lead = around[: int(draw.integers(0, min(room, len(around)) + 1))]
                    tail = around[len(lead) : len(lead) + int(draw.integers(0, room - len(lead) + 1))]
                    kept = [*lead, *kept, *tail]
                texts.append(" ".join(kept))
                labels.append(label)
    texts.extend(plain)
    labels.extend([0] * len(plain))
    order = draw.permutation(len(texts))
    return [texts[k] for k in order], np.array(labels)[order]


def sample_lines(docs: DataFrame, rows: int = NEGATIVES) -> list[str]:
    """One line without licence words from each of ``rows`` distinct texts, drawn by hash.

    A histogram of the distinct hashes finds the hash up to which ``rows`` texts lie, and only their
    lines are looked at; copies of a text count once.  Of a line NEGATIVE_CHARS characters are taken.
    """
    texts = docs.where(F.col("text").isNotNull())
    drawn, bucket = F.xxhash64("text").alias("_drawn"), F.shiftright("_drawn", 64 - DRAW_BITS)
    sizes = texts.select(drawn).distinct().groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.orderBy("bucket").collect()  # at most 2 ** DRAW_BITS rows
    total, until = 0, 1 << DRAW_BITS
    for row in counts:
        total += row["n"]
        if total >= 2 * rows:  # some texts have no line to give
            until = row["bucket"]
            break
    parts = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.lower(x).rlike(LICENCE_WORDS))
    picked = (
        texts.select(drawn, "text")
        .where(bucket <= until)
        .select("_drawn", parts.alias("_parts"))
        .where(F.size("_parts") > 0)
        .select("_drawn", F.get("_parts", F.pmod("_drawn", F.size("_parts")).cast("int")).alias("line"))
        .select("_drawn", F.substring("line", 1, NEGATIVE_CHARS).alias("line"))
        .dropDuplicates(["_drawn"])
    )
    return [row["line"] for row in picked.orderBy("_drawn", "line").limit(rows).collect()]


def fit(docs: DataFrame) -> Model:
    return Model(sample_lines(docs))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, family, probability, overlap, confirmed): a row per line and family seen there.

    ``line`` is that of the notice's first word, from 0.  Of several findings of a family in a line the
    one with the largest overlap counts.  ``confirmed`` says whether the paragraph holds LEAST_OVERLAP of
    a template of the family.  Null and empty texts have no findings; repeated rows repeat theirs;
    ids may be null; other columns are ignored.  Very long texts are read whole, in windows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = ["doc_id", "line", "family", "probability", "overlap"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < BLOCK:
                    size += len(texts[stop])
                    stop += 1
                found = shared.value.scan(texts[start:stop])
                if len(found):
                    best = found.sort_values(
                        ["text", "line", "family", "overlap", "probability"],
                        ascending=[True, True, True, False, False],
                    ).drop_duplicates(["text", "line", "family"])
                    ids = batch["doc_id"].iloc[start + best["text"].astype(int)].astype("Int64")
                    yield best.assign(doc_id=ids.to_numpy())[columns]
                start = stop

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    schema = "doc_id long, line int, family string, probability double, overlap double"
    found = rows.mapInPandas(run, schema)
    return found.withColumn("confirmed", F.col("overlap") >= LEAST_OVERLAP)
