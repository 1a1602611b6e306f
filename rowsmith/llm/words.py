"""Words and shingles of whole Arrow batches, as numpy arrays of 64-bit hashes.

A batch's texts are one byte buffer. Words are found by comparing neighbouring bytes, and
hashed by differences of one running sum, so the cost per byte is a few array passes and
no Python code runs per word. Hashes are the same on every executor and in every batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd factor, so that it has an inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
#: Texts are hashed in runs of about so many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR**i and FACTOR**-i modulo 2**64 for i up to size."""
    if not _powers or len(_powers["up"]) <= size:
        for name, factor in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            steps = np.full(max(size, RUN_BYTES) + 1, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray):
    """(first, last + 1) text of each run of about RUN_BYTES bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are blank, tab, line feed, vertical tab, form feed or carriage return."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def spans(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of one class; class 0 is between words, texts part runs."""
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(classes) + 1, bool)
    np.not_equal(classes[1:], classes[:-1], out=change[1:-1])
    change[0] = change[-1] = True
    change[offsets] = True
    cuts = np.flatnonzero(change)
    inside = classes[cuts[:-1]] != 0
    return cuts[:-1][inside], cuts[1:][inside]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: hash, first word of each text (n + 1), start and end bytes."""
    data = lowered(data) if lower else data
    starts, ends = spans((~white(data)).view(np.uint8), offsets)
    return hashed(data, starts, ends), np.searchsorted(starts, offsets), starts, ends


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size neighbouring words, also across texts."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(FACTOR) + hashes[k : k + len(total)]
    return mixed(total + np.uint64(size))


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = 5):
    """The sorted distinct shingle hashes of each text, in the order of the column.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    data, offsets = buffers(column)
    for first, last in runs(offsets):
        cut = offsets[first : last + 1]
        hashes, at, _, _ = words(data[cut[0] : cut[-1]], cut - cut[0])
        grams = ngrams(hashes, size)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo >= size:
                found = np.sort(grams[lo : hi - size + 1])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            else:
                yield ngrams(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)
