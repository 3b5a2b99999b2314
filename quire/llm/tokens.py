"""Whole Arrow batches of texts cut into words and hashed by NumPy, without a Python object for any word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words end at these bytes: space and 0x09 to 0x0D.
SPACES = np.ones(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Longer words, in bytes, are hashed one at a time.
LONG = 1 << 10
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, data


def pieces(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (first, last) of texts of about so many bytes, with offsets from 0 and the bytes of the run."""
    if not len(texts):
        return
    off, data = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, last, off[first : last + 1] - off[first], data[off[first] : off[last]]
        first = last


def words(off: np.ndarray, data: np.ndarray, kept: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, the number of words before each text (one more than texts), and lower-cased bytes."""
    low = LOWER[data]
    w = kept[low]
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64), low
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    begin = off[:-1][off[:-1] < off[1:]]  # no word goes on from one text into the next
    s[begin] = w[begin]
    e[begin[begin > 0] - 1] = w[begin[begin > 0] - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off), low


def hashes(starts: np.ndarray, ends: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its bytes in eights, each mixed into what stands before it, and its length.

    Words of over LONG bytes are hashed by BLAKE2b, so one word of any length takes no round for each eight bytes of it.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        part = eight[starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]
        h[more] = mix((h[more] * np.uint64(0x9E3779B97F4A7C15)) ^ part)
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row, text by text, and the count before each text.

    A text with fewer words, but not none, has its whole sequence as one.
    """
    count = np.diff(before)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    after = np.concatenate([[0], np.cumsum(made)])
    total = int(after[-1])
    if not total:
        return np.zeros(0, np.uint64), after
    owner = np.repeat(np.arange(len(count)), made)
    at = np.arange(total) - after[owner] + before[owner]
    out = np.zeros(total, np.uint64)
    size = np.minimum(count, n)[owner]
    for k in range(n):
        inside = k < size
        step = np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(0))
        out = np.where(inside, mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ step, out)
    return mix(out + size.astype(np.uint64)), after
