"""Words of many texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 1 << 21  # bytes handled at once: bounds memory; one text is never parted
WEIGHTS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a change of any bit changes about half of all bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def blocks(texts: Sequence[str]) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first text, texts in lower-case UTF-8), about BLOCK bytes at a time."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        data = text.lower().encode("utf-8", "surrogatepass")
        held.append(data)
        size += len(data)
        if size >= BLOCK:
            yield first, held
            first, held, size = row + 1, [], 0
    if held:
        yield first, held


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (a run of bytes above the blank), and the number of words by text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    inside = data > 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends_of_text))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    letters = data[inside].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(letters * WEIGHTS[place & 255], offsets)), counts
