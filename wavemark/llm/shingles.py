"""Hashes of word shingles of whole texts, for use inside Spark tasks.

Words are runs of characters other than the ASCII white space 0x20 and 0x09 to 0x0D, with A to Z in
lower case (bytes.lower() does exactly that to UTF-8).
"""

from __future__ import annotations

import numpy as np

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashed_words(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and the number of words of each. Words
    are found and hashed all at once, eight bytes at a time; no word becomes an object."""
    joined = b"\n".join([*encoded, bytes(8)])
    n = len(joined) - 8
    space = _SPACE[np.frombuffer(joined, np.uint8, n)]
    edge = np.diff(space, prepend=True)
    starts, ends = np.flatnonzero(edge & ~space), np.flatnonzero(edge & space)
    lengths = ends - starts
    eight = np.ndarray((n + 1,), "<u8", joined, strides=(1,))  # the eight bytes from each place on
    hashes = mix((eight[starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _MULTIPLY[0])
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        part = eight[starts[more] + at] & _MASKS[np.minimum(lengths[more] - at, 8)]
        hashes[more] = mix(hashes[more] * _MULTIPLY[1] + part)
        at += 8
        more = more[lengths[more] > at]
    stops = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
    return hashes, np.diff(np.searchsorted(starts, stops), prepend=0)


def windows(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each window of ``width`` words of each text, end to end, and how many each
    text has. A shorter text that has words is one window, hashed with its length."""
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: n - k] += hashes[k:] * _MULTIPLY[k % len(_MULTIPLY)]
    rolled = mix(rolled)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(n)  # words from here to the end of the text
    keep = left >= width
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        first = ends[i] - sizes[i]
        own = hashes[first : ends[i]] * _MULTIPLY[: sizes[i]] + np.uint64(sizes[i])
        rolled[first], keep[first] = mix(np.array([own.sum(dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)]))[0], True
    return rolled[keep], np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending. (np.unique alone may go by a hash table, which is slower.)"""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, end to end, and how many each has."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    sets = [sorted_distinct(rows[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each text: see ``distinct``. Null texts have the empty set."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    return distinct(*windows(*hashed_words(encoded), width))
