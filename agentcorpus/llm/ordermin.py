"""Operator 2: near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch holds, for each of its hash functions, the two minimal occurrence-labelled runs of words in
the order in which the text has them.  Runs of five words tell texts that differ in few places, and
some sketches of three-word runs find those whose edits lie scattered.  Texts that agree in a sketch meet
in its bucket.  All members of a bucket are compared with its first and its last member, and the
verified links joined to classes.  A bucket whose members are one class is settled.  In the others every
two members of different classes meet in panels of bounded size: bags of words bound the edits from
below, what the bags leave is aligned in the panel, and texts that a link has joined are not compared
again.  No pair that shares a bucket is dropped untested, and a panel returns fewer links than it has
members.  A pair is verified by its word edit distance in a band, and near if that leaves SIMILARITY of
the longer text.  Classes are the connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentcorpus.llm.store import numbered, stored
from agentcorpus.llm.words import blocks, mix, word_hashes

RUNS = ((5, 24), (3, 16))  # words in a run, sketches of such runs
SKETCHES = sum(count for _, count in RUNS)
BINS = 256  # of a bag: a text's words counted by hash
PANEL = 1024  # members of a bucket that meet as many others in one go,
PANEL_WORDS = 1 << 21  # and their words, about: both bound what a task holds
SIMILARITY = 0.8
FIRST = -(1 << 63)
ROW = "_near_row"
CELLS = 1 << 20  # cells of the padded pairs that are aligned together


def labelled_runs(
    hashes: np.ndarray, counts: np.ndarray, size: int = RUNS[0][0]
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words with its occurrence number in the text, and runs by text."""
    text = np.repeat(np.arange(len(counts)), counts)
    last = len(hashes) - size + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    runs = np.zeros(last, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x100000001B3) + hashes[k : k + last]
    inside = text[:last] == text[size - 1 :]
    runs, text = mix(runs[inside]), text[:last][inside]
    order = np.argsort(runs, kind="stable")
    sorted_runs, sorted_text = runs[order], text[order]
    again = (sorted_runs[1:] == sorted_runs[:-1]) & (sorted_text[1:] == sorted_text[:-1])
    if again.any():
        begins = np.concatenate(([0], np.flatnonzero(~again) + 1))
        lengths = np.diff(np.concatenate((begins, [len(runs)])))
        number = np.arange(len(runs)) - np.repeat(begins, lengths)
        runs[order] = mix(sorted_runs + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return runs, np.bincount(text, minlength=len(counts))


def sketch(runs: np.ndarray, counts: np.ndarray, numbers: range = range(RUNS[0][1])) -> np.ndarray:
    """One key per hash function of ``numbers`` for every text that has a run, rows in text order."""
    counts = counts[counts > 0]
    begins = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    keys = np.zeros((len(counts), len(numbers)), np.uint64)
    if not len(counts):
        return keys
    top = np.uint64(0xFFFFFFFFFFFFFFFF)

    def lowest(values: np.ndarray) -> np.ndarray:
        least = np.minimum.reduceat(values, begins)
        at = np.flatnonzero(values == np.repeat(least, counts))
        return at[np.concatenate(([True], text[at[1:]] != text[at[:-1]]))]

    for column, number in enumerate(numbers):
        values = mix(runs ^ mix(np.full(1, number + 1, np.uint64)))
        first = lowest(values)
        values[first] = top
        second = np.where(counts > 1, lowest(values), first)
        low, high = np.minimum(first, second), np.maximum(first, second)
        keys[:, column] = mix(mix(runs[low]) + runs[high] + np.uint64(number))
    return keys


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text, its sketch keys, and whether it has any: five words at least."""
    hashes, counts = word_hashes(texts)
    keys, used = np.zeros((len(texts), SKETCHES), np.uint64), 0
    enough = counts >= RUNS[0][0]
    for size, count in RUNS:
        runs, by_text = labelled_runs(hashes, counts, size)
        keys[by_text > 0, used : used + count] = sketch(runs, by_text, range(used, used + count))
        used += count
    return counts, keys, enough


def sketches(docs: DataFrame) -> DataFrame:
    """A row per distinct text: first id and row, 128-bit key, number of words, sketch keys.

    Texts of fewer than five words, and null, have no keys.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for first, held in blocks(texts):
                counts, found, enough = keys_of(held)
                keys = [
                    row.tolist() if good else [] for row, good in zip(found.view(np.int64), enough)
                ]
                part = batch.iloc[first : first + len(held)].drop(columns="text")
                yield part.assign(words=counts, keys=keys)

    schema = "_order long, _row long, k1 long, k2 long, words long, keys array<long>"
    made = with_keys(docs).where(F.col("text").isNotNull()).mapInPandas(run, schema)
    found = made.groupBy("k1", "k2").agg(
        F.min(F.struct("_order", "_row")).alias("_first"),
        F.min("words").alias("words"),
        F.min("keys").alias("keys"),
    )
    found = found.select("_first._order", "_first._row", "k1", "k2", "words", "keys")
    return numbered(found, [F.col(c) for c in ("_order", "k1", "k2")], "id")


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("_order"),
        F.col(ROW).alias("_row"),
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit("second"), "text").alias("k2"),
        "text",
    )


def sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Word hashes (32 bits each) of the wanted texts, taken from each text's first row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, held in blocks(batch["text"].tolist()):
                hashes, counts = word_hashes(held)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                parts = np.split(short, np.cumsum(counts)[:-1])
                ids = batch["id"].iloc[first : first + len(held)]
                yield pd.DataFrame({"id": ids, "seq": [p.tobytes() for p in parts]})

    joined = with_keys(docs).join(wanted.select("id", "_row"), "_row").select("id", "text")
    return joined.mapInPandas(run, "id long, seq binary")


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether enough words are common, in any order, for at most ``most`` edits."""
    _, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    size = int(place.max(initial=-1)) + 1
    common = np.minimum(
        np.bincount(place[: len(a)], minlength=size), np.bincount(place[len(a) :], minlength=size)
    )
    return max(len(a), len(b)) - int(common.sum()) <= most


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common beginning and end."""
    size = min(len(a), len(b))
    apart = a[:size] != b[:size]
    start = int(apart.argmax()) if apart.any() else size
    a, b = a[start:], b[start:]
    size = min(len(a), len(b))
    apart = a[len(a) - size :][::-1] != b[len(b) - size :][::-1]
    stop = int(apart.argmax()) if apart.any() else size
    return a[: len(a) - stop], b[: len(b) - stop]


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances in a band of ``width`` diagonals to either side, all pairs row by row together.

    Exact where the result is at most ``width``.
    """
    rows, size = max(len(a) for a, _ in pairs), 2 * width + 1
    far = np.int32(1 << 28)
    left = np.zeros((len(pairs), rows), np.int64)
    right = np.full((len(pairs), max(len(b) for _, b in pairs) + rows + 2 * size), -1, np.int64)
    for at, (a, b) in enumerate(pairs):
        left[at, : len(a)] = a
        right[at, width : width + len(b)] = b
    ends = np.array([len(a) for a, _ in pairs])
    goal = np.array([len(b) - len(a) + width for a, b in pairs])
    steps = np.arange(size, dtype=np.int32)
    band = np.broadcast_to(np.where(steps >= width, steps - width, far), (len(pairs), size)).copy()
    result = np.full(len(pairs), far)
    reachable = (goal >= 0) & (goal < size)
    every = np.arange(len(pairs))
    for row in range(rows + 1):
        done = (ends == row) & reachable
        if done.any():
            result[done] = band[every[done], goal[done]]
        if row == rows:
            break
        best = band + (right[:, row : row + size] != left[:, row, None])
        best[:, :-1] = np.minimum(best[:, :-1], band[:, 1:] + 1)
        band = np.minimum.accumulate(best - steps, axis=1) + steps
        band = np.minimum(band, far).astype(np.int32)
    return result


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], share: float = SIMILARITY) -> np.ndarray:
    """Whether 1 - edits / longer length is at least ``share``, by bands that widen as needed."""
    most = [int((1 - share) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    verdict = np.zeros(len(pairs), bool)
    open_pairs = []
    for at, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) <= most[at] and within(a, b, most[at]):
            a, b = trimmed(a, b)
            if min(len(a), len(b)) == 0:
                verdict[at] = max(len(a), len(b)) <= most[at]
            else:
                open_pairs.append((at, (a, b) if len(a) <= len(b) else (b, a)))
    width = 8
    while open_pairs:
        open_pairs.sort(key=lambda p: len(p[1][0]))
        following = []
        group: list = []
        for item in [*open_pairs, None]:
            longest = len((item or open_pairs[-1])[1][1]) + 2 * width
            if group and (item is None or (len(group) + 1) * longest > CELLS):
                edits = banded([pair for _, pair in group], width)
                for (at, pair), found in zip(group, edits):
                    if found <= width:
                        verdict[at] = found <= most[at]
                    elif width < most[at]:
                        following.append((at, pair))
                group = []
            if item is not None:
                group.append(item)
        open_pairs, width = following, 4 * width
    return verdict


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (id, to) whose texts are near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [
                (np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32))
                for a, b in zip(batch["seq"], batch["other"])
            ]
            yield batch.loc[similar(read), ["id", "to"]]

    others = texts.select(F.col("id").alias("to"), F.col("seq").alias("other"))
    return pairs.join(texts, "id").join(others, "to").mapInPandas(run, "id long, to long")


def bucket_keys() -> Column:
    return F.array(*[F.xxhash64(F.lit(k), F.get("keys", F.lit(k))) for k in range(SKETCHES)])


def linked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, class) of the distinct texts that have links: the least id that can be reached.

    Any two texts that share a bucket are in one class or were compared.
    """
    rows = marks.where(F.size("keys") > 0).select("id", "words", "keys")
    level = rows.select("id", "words", F.posexplode(bucket_keys()).alias("number", "key"))
    groups = level.groupBy("key").agg(
        F.min(F.struct("id", "words")).alias("low"),
        F.max(F.struct("id", "words")).alias("high"),
        F.count(F.lit(1)).alias("size"),
    )
    groups = groups.where("low.id < high.id").select(
        "key",
        "size",
        F.col("low.id").alias("low"),
        F.col("low.words").alias("low_words"),
        F.col("high.id").alias("high"),
        F.col("high.words").alias("high_words"),
    )
    members = stored(level.join(stored(groups, "buckets"), "key"), "members")
    if members.isEmpty():
        return docs.sparkSession.createDataFrame([], "id bigint, class bigint")

    def toward(end: str) -> DataFrame:
        words, other = F.col("words"), F.col(f"{end}_words")
        enough = F.least(words, other) >= SIMILARITY * F.greatest(words, other)
        pair = members.where((F.col("id") != F.col(end)) & enough)
        return pair.select(F.greatest("id", end).alias("id"), F.least("id", end).alias("to"))

    tested = stored(toward("low").unionByName(toward("high")).distinct(), "pairs")
    texts = stored(sequences(docs, marks.join(members.select("id").distinct(), "id")), "sequences")
    found = components(stored(verified(tested, texts), "near"))

    more = stored(crossing(members, found, rows, texts), "crossing")
    for end in ("id", "to"):  # links between classes
        over = found.select(F.col("id").alias(end), "class")
        more = more.join(over, end, "left").withColumn(end, F.coalesce("class", end)).drop("class")
    joined = components(more)
    found = found.unionByName(joined.select("id", F.col("id").alias("class"))).distinct()
    over = joined.select(F.col("id").alias("class"), F.col("class").alias("_over"))
    return found.join(over, "class", "left").select("id", F.coalesce("_over", "class").alias("class"))


def crossing(members: DataFrame, found: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (id, to) between texts of one bucket and different classes.

    The ends of a bucket have met all others.  Of the rest, those outside its largest class meet
    every member, in panels that are dealt out; members of that class do not meet each other.
    """
    inner = members.where((F.col("size") > 3) & ~F.col("id").isin(F.col("low"), F.col("high")))
    inner = inner.join(found, "id", "left").select(
        "key", "number", "id", "words", F.coalesce("class", "id").alias("class")
    )
    inner = stored(inner, "inner")
    sizes = inner.groupBy("key", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")
    )
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("n", "class", "words")).alias("major"),
        F.sum("n").alias("all"),
        F.sum("words").alias("all_words"),
    )

    def panels(count: Column, words: Column) -> Column:
        return F.greatest(F.ceil(count / PANEL), F.ceil(words / PANEL_WORDS))

    mixed = mixed.where("major.n < all").select(
        "key",
        F.col("major.class").alias("major"),
        panels(F.col("all") - F.col("major.n"), F.col("all_words") - F.col("major.words")).alias("down"),
        panels(F.col("all"), F.col("all_words")).alias("across"),
    )
    left = stored(inner.join(mixed, "key"), "mixed")
    marked = texts.join(left.select("id").distinct(), "id").join(rows.select("id", "keys"), "id")
    own = F.xxhash64("id")
    i, j = F.pmod(own, F.col("down")), F.pmod(own, F.col("across"))
    spot = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    count = lambda size: F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1)
    asked = F.transform(count("down"), lambda k: spot(k, j, False))
    asking = F.transform(count("across"), lambda k: spot(i, k, True))
    minor = F.col("class") != F.col("major")
    dealt = left.join(marked.mapInPandas(signed, "id long, sign binary, seq binary"), "id").select(
        "key",
        "number",
        "id",
        "words",
        "class",
        "sign",
        "seq",
        minor.alias("minor"),
        F.explode(F.when(minor, F.concat(asked, asking)).otherwise(asked)).alias("spot"),
    )
    dealt = dealt.select("*", "spot.i", "spot.j", "spot.asks").drop("spot")
    panels = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return panels.mapInPandas(meetings, "id long, to long").distinct()


def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text its sketch keys and its bag, counts up to 255, as bytes, and its words."""
    for batch in batches:
        signs = []
        for seq, keys in zip(batch["seq"], batch["keys"]):
            bag = np.bincount(np.frombuffer(seq, np.uint32) % BINS, minlength=BINS)
            signs.append(np.array(keys, "<i8").tobytes() + np.minimum(bag, 255).astype(np.uint8).tobytes())
        yield pd.DataFrame({"id": batch["id"], "sign": signs, "seq": batch["seq"]})


def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of every panel; rows come panel by panel."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        panel = held[["key", "i", "j"]].to_numpy()
        last = len(panel) - int((panel[::-1] != panel[-1]).any(axis=1).argmax())
        last = last if (panel[0] != panel[-1]).any() else 0
        yield from met(held.iloc[:last])
        held = held.iloc[last:]
    if held is not None:
        yield from met(held)


class Joined:
    """Classes of a panel's members, merged as links are found."""

    def __init__(self, classes: np.ndarray) -> None:
        self.number = np.unique(classes, return_inverse=True)[1]

    def merge(self, a: int, b: int) -> bool:
        x, y = self.number[a], self.number[b]
        if x != y:
            self.number[self.number == y] = x
        return bool(x != y)


def links(
    a: np.ndarray, b: np.ndarray, apart: np.ndarray, seqs: list[np.ndarray], joined: Joined
) -> Iterator[tuple[int, int]]:
    """Links that join the classes of the open pairs (a, b), likeliest first.

    The first round aligns one pair per two classes and every later one four times as many; pairs of
    texts that links have joined meanwhile drop out.
    """
    order = np.argsort(apart, kind="stable")
    a, b, size = a[order], b[order], 1
    while len(a):
        x, y = joined.number[a], joined.number[b]
        a, b, x, y = (values[x != y] for values in (a, b, x, y))
        if not len(a):
            return
        two = np.minimum(x, y) * (joined.number.max() + 1) + np.maximum(x, y)
        order = np.argsort(two, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], np.diff(two[order]) != 0)))
        place = np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a))))
        chosen = np.zeros(len(a), bool)
        chosen[order[place < size]] = True
        at = np.flatnonzero(chosen)
        for k in at[similar([(seqs[i], seqs[j]) for i, j in zip(a[at], b[at])])]:
            if joined.merge(a[k], b[k]):
                yield a[k], b[k]
        a, b, size = a[~chosen], b[~chosen], 4 * size


def met(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Links of whole panels.  A pair is met in the bucket of its first common sketch."""
    if not len(rows):
        return
    signs = np.frombuffer(b"".join(rows["sign"]), np.uint8).reshape(len(rows), -1)
    keys = np.ascontiguousarray(signs[:, : 8 * SKETCHES]).view("<i8")
    bags = signs[:, 8 * SKETCHES :].astype(np.int16)
    seqs = [np.frombuffer(seq, np.uint32) for seq in rows["seq"]]
    ids, words, own, number, minor, asks = (
        rows[c].to_numpy() for c in ("id", "words", "class", "number", "minor", "asks")
    )
    panel = rows[["key", "i", "j"]].to_numpy()
    edges = np.flatnonzero((panel[1:] != panel[:-1]).any(axis=1)) + 1
    found = []
    for first, last in zip([0, *edges], [*edges, len(rows)]):
        joined = Joined(own[first:last])
        inside = asks[first:last]
        down, across = first + np.flatnonzero(inside), first + np.flatnonzero(~inside)
        step = max(1, CELLS // BINS // max(len(across), 1))
        for start in range(0, len(down), step):
            part = down[start : start + step, None]
            apart = joined.number[part - first] != joined.number[across - first]
            x, y = np.nonzero(apart & (~minor[across] | (ids[part] < ids[across])))
            a, b = part[x, 0], across[y]
            most = ((1 - SIMILARITY) * np.maximum(words[a], words[b]) + 1e-9).astype(np.int64)
            longer = np.abs(words[a] - words[b])
            fits = longer <= most
            fits &= ~(keys[a, : number[first]] == keys[b, : number[first]]).any(axis=1)
            a, b, most, longer = a[fits], b[fits], most[fits], longer[fits]
            # edits are at least the words of the longer text that the bags cannot match
            least = longer + np.abs(bags[a] - bags[b]).sum(axis=1, dtype=np.int64)
            near = least <= 2 * most
            a, b, least = a[near] - first, b[near] - first, least[near] / np.maximum(most[near], 1)
            own_seqs = seqs[first:last]
            found += [(ids[first + i], ids[first + j]) for i, j in links(a, b, least, own_seqs, joined)]
    if found:
        pairs = np.array(found).T
        yield pd.DataFrame({"id": pairs.max(axis=0), "to": pairs.min(axis=0)})


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the least id that can be reached.

    Every id hangs on its least smaller neighbour; pointers are doubled until they reach the roots of
    these trees, the trees are contracted, and the few edges left between roots are gone over again.
    """
    lower, upper = F.least("id", "to").alias("to"), F.greatest("id", "to").alias("id")
    edges = stored(edges.where("id <> to").select(upper, lower).distinct(), "edges")
    ends = edges.select("id").unionByName(edges.select(F.col("to").alias("id"))).distinct()
    labels = stored(ends.select("id", F.col("id").alias("class")), "labels")
    while not edges.isEmpty():
        parents = stored(edges.groupBy("id").agg(F.min("to").alias("root")), "parents")
        while True:
            above = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = stored(
                parents.join(above, "root", "left").select(
                    "id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
                ),
                "jumped",
            )
            parents = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        over = parents.select(F.col("id").alias("class"), "root")
        labels = stored(
            labels.join(over, "class", "left").select("id", F.coalesce("root", "class").alias("class")),
            "labels",
        )
        for end in ("id", "to"):
            over = parents.select(F.col("id").alias(end), "root")
            edges = edges.join(over, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = stored(edges.where("id <> to").select(upper, lower).distinct(), "edges")
    return labels


def classes(docs: DataFrame) -> DataFrame:
    """(k1, k2, class_order, class_row) per distinct text: its class's first document."""
    marks = stored(sketches(docs), "sketches")
    found = linked(docs, marks)
    roots = marks.select(
        F.col("id").alias("class"), F.col("_order").alias("class_order"), F.col("_row").alias("class_row")
    )
    return stored(
        marks.select("id", "k1", "k2")
        .join(found, "id", "left")
        .withColumn("class", F.coalesce("class", "id"))
        .join(roots, "class")
        .select("k1", "k2", "class_order", "class_row"),
        "classes",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Add ``class_id``, the doc_id of the first document of the row's class, ``class_key``, a number
    that tells classes apart whatever their ids, and ``stays``.

    Two texts are near if their words (lower case, parted by white space) need at most a fifth as
    many insertions, deletions and replacements as the longer has words; classes join texts by
    chains of near ones.  Candidates are found by chance: of pairs with four of five words left, the
    rest replaced at scattered places, at least nine in ten share a bucket, and nearly all of more
    similar ones.  Two texts that share a bucket are compared, however crowded it is, unless other
    links join them already.

    The first document is the one of least doc_id, null first; among equal ids, of least text hash;
    among equal rows, one of them.  It alone stays.  Equal texts are always one class.  Texts of fewer
    than five words, and empty ones, are compared as a whole only.  A row with null text is a class of
    its own and stays.  An empty table gives no rows; columns of these names are replaced.  Very long
    texts are aligned whole, in a band of up to a fifth of their words: two near texts of a million
    words that differ in that many places are the costliest case, 4 x 10^11 cells in one task.

    The rows are stored once under a row number, so that every step sees the same ones.
    """
    docs = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    found = classes(docs)
    found = found.select(*[F.col(c).alias(f"_near_{c}") for c in found.columns])
    text = F.col("text")
    joined = docs.withColumns(
        {"_key1": F.xxhash64(text), "_key2": F.xxhash64(F.lit("second"), text)}
    ).join(
        found,
        (F.col("_key1") == F.col("_near_k1")) & (F.col("_key2") == F.col("_near_k2")),
        "left",
    )
    leader = F.col("_near_class_order")
    return joined.withColumns(
        {
            "class_id": F.when(text.isNull(), F.col("doc_id")).when(leader != FIRST, leader),
            "class_key": F.coalesce("_near_class_row", ROW),
            "stays": F.coalesce(F.col(ROW) == F.col("_near_class_row"), F.lit(True)),
        }
    ).drop("_key1", "_key2", ROW, *found.columns)
