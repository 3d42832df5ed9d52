"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z as a-z, and where each text's words begin (one more than texts).

    A text's words are its runs of bytes other than the six ASCII blanks; a NULL text has none. One sum over the
    bytes, each times a power of an odd number, gives every word's hash as a difference of two partial sums.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, last - first, first)]
    offsets = offsets - first
    word = ~_BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = word[edge]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    shut = offsets[1:][offsets[1:] > 0] - 1
    ends[shut] = word[shut]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    hashed = (sums[stop] - sums[start]) * _powers(_UNBASE, len(data))[start]
    hashed = mix(hashed + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashed, np.searchsorted(start, offsets)


def portions(texts: pa.Array, most_bytes: int = 1 << 21, most_rows: int = 2048) -> Iterator[tuple[int, int]]:
    """(first, count) of consecutive runs of texts of at most ``most_bytes`` together; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1
        end = max(at + 1, min(end, at + most_rows, len(texts)))
        yield at, end - at
        at = end


def shingle_sets(texts: pa.Array, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """:func:`_some_sets` over a portion of the texts at a time, which bounds the numbers held per byte of text."""
    sets: list[np.ndarray] = []
    digests = [np.zeros((0, 2), np.int64)]
    for at, count in portions(texts):
        some, digest = _some_sets(texts.slice(at, count), length)
        sets.extend(some)
        digests.append(digest)
    return sets, np.concatenate(digests)


def _some_sets(texts: pa.Array, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and a (n, 2) digest of each text's whole word sequence.

    A text of fewer words is one shingle; one without words has an empty set.
    """
    words, begin = word_hashes(texts)
    runs = words.copy()
    for i in range(1, length):
        runs = runs[:-1] if len(runs) else runs
        runs = mix(runs * np.uint64(0xA0761D6478BD642F) + words[i : i + len(runs)])
    sets, digests = [], np.zeros((len(texts), 2), np.int64)
    for k in range(len(texts)):
        a, b = int(begin[k]), int(begin[k + 1])
        if b - a >= length:
            sets.append(np.unique(runs[a : b - length + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for at in range(a, b):
                value = mix(value * np.uint64(31) + words[at : at + 1])
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
        if b > a:
            at = np.arange(1, b - a + 1, dtype=np.uint64)
            one = np.bitwise_xor.reduce(mix(words[a:b] + at * np.uint64(0x8BB84B93962EACC9)))
            two = np.add.reduce(mix(words[a:b] ^ (at * np.uint64(0x2D358DCCAA6C78A5))), dtype=np.uint64)
            digests[k] = np.array([one, two], np.uint64).view(np.int64)
    return sets, digests
