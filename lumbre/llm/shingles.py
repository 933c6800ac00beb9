"""Word shingles of a text as 64-bit hashes, in NumPy; used inside Arrow tasks."""

from __future__ import annotations

import numpy as np

#: Bytes of white space between words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20_240_601))
BYTE_VALUES = _random.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; longer texts are cut between words.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_hashes(data: np.ndarray) -> np.ndarray:
    inside = ~SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, BASE, np.uint64))
    letters = data[inside]
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return mix(np.add.reduceat(BYTE_VALUES[letters] * powers[place], firsts) + lengths.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a UTF-8 text, with A-Z in lower case."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    parts, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):  # to the next white space
            gap = np.flatnonzero(SPACES[data[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + SEGMENT, len(data))
        parts.append(_segment_hashes(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of ``words`` words, sorted; of a shorter text the whole sequence; none without words."""
    each = word_hashes(text)
    if not len(each):
        return each
    size = min(words, len(each))
    out = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * BASE + each[k : k + len(out)] + np.uint64(k + 1))
    return np.unique(mix(out + np.uint64(size)))
