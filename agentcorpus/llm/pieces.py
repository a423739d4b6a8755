"""Operator 3: SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into words (a word carries the blanks before it; no piece has a blank after another
character), and distinct words of about equal length advance through the lattice together.  Hashes of the
substrings that end at a place probe the sorted keys of the pieces; the vectorised maximum over the
arcs is stored as the backpointer.

The model at hand is of the merge type, whose encoding is not the path of the best score sum (that
path agrees for 58 % of the words in running text).  The arc weights are therefore transitions: an
arc is open if its piece may follow the last piece of the path before it, that is if merging both
texts in order of score would stop at this very pair.  Every prefix then has one open path, and it is
the library's encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
CACHE = 300_000  # words whose ids a worker keeps
CHUNK = 1 << 21  # characters of texts, or of new words with their padding, that advance together
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS  # pairs of pieces whose answer a worker keeps
NEVER = np.int64(1) << 40
BASE = np.uint64(0x9E3779B97F4A7C15)


def character_codes(codes: np.ndarray) -> np.ndarray:
    """A random-looking odd number per code point, for the rolling hash of substrings."""
    values = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)


def string_hash(text: str) -> int:
    value = 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for code in character_codes(codes).tolist():
        value = (value * int(BASE) + code) & 0xFFFFFFFFFFFFFFFF
    return value


def merged(text: str, rank: dict[str, int]) -> tuple[list[str], int]:
    """Merge the characters of a short text in order of rank, leftmost first; the parts, and where
    the last merge joined two of them."""
    parts, split = list(text), 0
    while True:
        options = [(rank[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not options:
            return parts, split
        at = min(options)[1]
        split = len(parts[at])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Vocabulary:
    """Pieces of a merge-type model as arrays, fit to be broadcast."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        normal = [
            i
            for i in every
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        names = {i: model.id_to_piece(i) for i in normal}
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        rank = {names[i]: at for at, i in enumerate(order)}
        # a piece that merging does not lead to is never part of an encoding
        halves = {}
        for i in normal:
            parts, split = merged(names[i], rank) if len(names[i]) > 1 else ([names[i]], 0)
            if len(parts) == 1:
                halves[i] = split
        ids = np.array([i for i in order if i in halves], np.int64)
        hashes = np.array([string_hash(names[i]) for i in ids], np.uint64)
        at = np.argsort(hashes)
        self.keys, self.ids = hashes[at], ids[at]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        texts = [names[i] for i in self.ids]
        place = {text: k for k, text in enumerate(texts)}
        self.length = np.array([len(t) for t in texts], np.int64)
        self.longest = int(self.length.max(initial=1))
        self.rank = np.array([rank[t] for t in texts], np.int64)
        # all pieces can result from a merge on the way, reachable by themselves or not
        both = sorted((string_hash(t), r) for t, r in rank.items())
        self.merge_keys = np.array([h for h, _ in both], np.uint64)
        self.merge_rank = np.array([r for _, r in both], np.int64)
        cut = [halves[i] for i in self.ids]
        self.left = np.array([place.get(t[:c], k) if c else k for k, (t, c) in enumerate(zip(texts, cut))])
        self.right = np.array([place.get(t[c:], k) if c else k for k, (t, c) in enumerate(zip(texts, cut))])
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * model.vocab_size()
        for i in normal:
            self.raw[i] = names[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self.seen = np.zeros(1 << 20, bool)  # whether any piece's hash begins so: spares most probes
        self.seen[self.keys >> np.uint64(44)] = True
        self.powers = np.ones(max(self.longest, 3) + 1, np.uint64)
        for k in range(1, len(self.powers)):
            self.powers[k : k + 1] = self.powers[k - 1 : k] * BASE
        if self.longest > 63:
            raise ValueError("a piece is longer than 63 characters")
        # bits of the lengths of pieces whose last two (of two) or three characters hash to a place
        self.tails = {2: np.zeros(1 << 20, np.uint64), 3: np.zeros(1 << 20, np.uint64)}
        for one in texts:
            if len(one) > 1:
                tail = min(len(one), 3)
                self.tails[tail][string_hash(one[-tail:]) >> 44] |= np.uint64(1 << len(one))
        self.asked: np.ndarray | None = None

    def merge_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces, or NEVER."""
        size = self.length[b]
        fits = self.length[a] + size <= self.longest
        joined = self.keys[a] * self.powers[size] + self.keys[b]
        at = np.minimum(np.searchsorted(self.merge_keys, joined), len(self.merge_keys) - 1)
        return np.where(fits & (self.merge_keys[at] == joined), self.merge_rank[at], NEVER)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`stay_apart` of pairs, which recur: the last answer of each slot is kept."""
        if self.asked is None:  # made by the worker, not sent to it
            self.asked, self.answers = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        pair = a.astype(np.int64) * len(self.keys) + b
        slot = (pair.astype(np.uint64) * BASE) >> np.uint64(64 - SLOT_BITS)
        good = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != pair)
        if len(new):
            good[new] = self.stay_apart(a[new], b[new])
            self.asked[slot[new]], self.answers[slot[new]] = pair[new], good[new]
        return good

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of a and b together leaves just these two pieces.

        Going back in time, the later formed of the two pieces at the border is taken apart; in each
        state the two that touch must not have merged before one of them was taken up.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        before = np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            good[live] = self.merge_at(x, y) >= before[live]
            whole_x, whole_y = self.left[x] == x, self.left[y] == y
            open_ = good[live] & ~(whole_x & whole_y)
            live, x, y = live[open_], x[open_], y[open_]
            whole_x, whole_y = whole_x[open_], whole_y[open_]
            back_x = ~whole_x & (whole_y | (self.rank[x] > self.rank[y]))
            # of equal merges the left one comes first
            before[live] = np.where(back_x, self.rank[x], self.rank[y] + 1)
            a[live] = np.where(back_x, self.right[x], x)
            b[live] = np.where(back_x, y, self.left[y])
        return good

    def encode_equal(self, words: Sequence[str]) -> list[bytes]:
        """Ids of words of about equal length, as little-endian 32-bit bytes.

        The longest words come first, so that those with an n-th character are the first ones.
        """
        sizes = np.array([len(word) for word in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        words, sizes = [words[i] for i in order.tolist()], sizes[order]
        count, size = len(words), int(sizes[0])
        text = "".join(words).encode("utf-32-le", "surrogatepass")
        codes = np.zeros((count, size), np.uint64)
        codes[np.arange(size) < sizes[:, None]] = character_codes(np.frombuffer(text, np.uint32))
        codes = np.ascontiguousarray(codes.T)
        prefix = np.zeros((size + 1, count), np.uint64)
        for at in range(size):
            prefix[at + 1] = prefix[at] * BASE + codes[at]
        last = np.full((size + 1, count), -1, np.int32)  # last piece of the prefix, -1: none
        back = np.zeros((size + 1, count), np.int32)  # its length
        for end in range(1, size + 1):
            waiting = np.arange(np.searchsorted(-sizes, -end, "right"))
            lengths = self._lengths(prefix, end, len(waiting))
            for length in range(min(end, self.longest), 0, -1):
                start = end - length
                asked = waiting
                if length > 1:
                    asked = waiting[(lengths[waiting] >> np.uint64(length)) & np.uint64(1) > 0]
                    if not len(asked):
                        continue
                else:  # a character without piece is an arc of its own
                    back[end, waiting] = 1
                hashes = prefix[end, asked] - prefix[start, asked] * self.powers[length]
                maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
                hashes = hashes[maybe]
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                there = self.keys[at] == hashes
                rows, piece = asked[maybe[there]], at[there]
                if not len(rows):
                    continue
                previous = last[start, rows]
                fits = (back[start, rows] > 0) | (start == 0)
                paired = fits & (previous >= 0)
                fits[paired] = self.may_follow(previous[paired], piece[paired])
                rows, piece = rows[fits], piece[fits]
                last[end, rows], back[end, rows] = piece, length
                keep = np.ones(count, bool)
                keep[rows] = False
                waiting = waiting[keep[waiting]]
                if not len(waiting):
                    break
        found = self._walk(words, sizes, last, back)
        placed = [b""] * count
        for at, one in zip(order.tolist(), found):
            placed[at] = one
        return placed

    def _lengths(self, prefix: np.ndarray, end: int, count: int) -> np.ndarray:
        """Bits of the lengths above 1 that a piece with the same last two or three characters has."""
        found = np.zeros(count, np.uint64)
        for tail, table in self.tails.items():
            if end >= tail:
                hashes = prefix[end, :count] - prefix[end - tail, :count] * self.powers[tail]
                found |= table[hashes >> np.uint64(44)]
        return found

    def _walk(
        self, words: Sequence[str], sizes: np.ndarray, last: np.ndarray, back: np.ndarray
    ) -> list[bytes]:
        """Follow the backpointers of all words together."""
        count, size = len(words), int(sizes[0])
        path = np.full((count, size), -2, np.int64)
        end, every = sizes.copy(), np.arange(count)
        for step in range(size - 1, -1, -1):
            live = every[end > 0]
            if not len(live):
                break
            path[live, step] = last[end[live], live]
            end[live] -= back[end[live], live]
        used = path > -2
        ids = np.where(path >= 0, self.ids[path], -1)[used].astype("<i4")
        data, stops = ids.tobytes(), 4 * np.cumsum(used.sum(axis=1))
        found = [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        for row in np.flatnonzero((path == -1).any(axis=1)):  # characters without a piece
            found[row] = self._with_bytes(words[row], found[row])
        return found

    def _with_bytes(self, word: str, ids: bytes) -> bytes:
        full: list[int] = []
        at = 0
        for one in np.frombuffer(ids, "<i4").tolist():
            if one >= 0:
                full.append(one)
                at += len(self.raw[one].decode())
            else:
                full.extend(self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass"))
                at += 1
        return np.array(full, "<i4").tobytes()

    def encode_new(self, words: Sequence[str]) -> dict[str, bytes]:
        by_size: dict[int, list[str]] = {}
        for word in words:  # lengths 1 to 8, 9 to 16, 17 to 32 and so on
            by_size.setdefault(max(8, 1 << (len(word) - 1).bit_length()), []).append(word)
        found: dict[str, bytes] = {}
        for size, group in by_size.items():
            step = max(1, CHUNK // size)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                found.update(zip(part, self.encode_equal(part)))
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes in a row, without the blank put before it."""
        return b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


class Encoder:
    """Encodes batches of texts; keeps the ids of known words up to CACHE of them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> Iterator[list[np.ndarray]]:
        """Ids of the texts, in lists of as many texts as make about CHUNK characters."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            words = WORDS.findall(BLANK + text.replace(" ", BLANK)) if text else []
            group.append(words)
            size += len(text)
            if size >= CHUNK:
                yield list(self._ids(group))
                group, size = [], 0
        if group:
            yield list(self._ids(group))

    def _ids(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        wanted = set().union(*group) if group else set()
        if len(self.known) + len(wanted) > CACHE:
            self.known = {}
        self.known |= self.vocabulary.encode_new([w for w in wanted if w not in self.known])
        for words in group:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4")


def encode(
    docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Add piece ids of whole texts, as the library encodes them.

    Null text gives null, empty text an empty array.  White space other than the blank is an
    ordinary character; the sign U+2581 is a blank.  Equal texts get equal ids.  With ``decoded`` the
    ids are also decoded in the same pass, into a column of that name.  Columns of these names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    back = decoded is not None

    @F.pandas_udf("ids array<int>" + ", decoded string" * back)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            gone = batch.isna().tolist()
            start = 0
            for part in encoder.encode(batch.fillna("").tolist()):
                missing = gone[start : start + len(part)]
                start += len(part)
                frame = {"ids": [None if no else one for no, one in zip(missing, part)]}
                if back:
                    frame["decoded"] = [
                        None if no else shared.value.decode(one) for no, one in zip(missing, part)
                    ]
                yield pd.DataFrame({name: pd.Series(v, dtype=object) for name, v in frame.items()})

    found = docs.withColumn("_pieces", run(text)).withColumn(ids, F.col("_pieces.ids"))
    if back:
        found = found.withColumn(decoded, F.col("_pieces.decoded"))
    return found.drop("_pieces")


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of piece ids; null gives null, bytes that are no UTF-8 the replacement sign."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda one: None if one is None else shared.value.decode(np.asarray(one)))

    return rows.withColumn(text, run(ids))
