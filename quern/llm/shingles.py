"""64-bit hashes of words and of runs of words, by whole arrays of bytes."""

from __future__ import annotations

import numpy as np
import xxhash

_SEED = np.random.Generator(np.random.PCG64(20240917))
#: Odd factors.
_FACTORS = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place of a byte array, as little-endian numbers; the last 7 places are left out."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def run_hashes(text: bytes, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the longest runs of bytes that `solid` marks; equal runs have equal hashes. The
    bytes go in eight at a time, each step mixed before the next."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    inside = np.concatenate([[False], solid[data[:-8]], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    words = eights(data)
    out = mix((words[starts] & _FIRST[np.minimum(sizes, 8)]) * _FACTORS[62] + sizes.astype(np.uint64) * _FACTORS[63])
    for k in range(8, min(int(sizes.max(initial=0)), _LONG), 8):
        more = np.flatnonzero(sizes > k)
        out[more] = mix(out[more] * _FACTORS[61] + (words[starts[more] + k] & _FIRST[np.minimum(sizes[more] - k, 8)]))
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + sizes[i]])
    return starts, out


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word: run of bytes other than ASCII white space."""
    return run_hashes(text, ~_BLANK)[1]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's `width`-word shingles, A-Z in lower case; of a shorter text
    the whole word sequence as one; none without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if not n:
        return words
    used = min(n, width)
    runs = np.full(n - used + 1, np.uint64(used), np.uint64)
    for j in range(used):
        runs = runs * _FACTORS[60] + words[j : n - used + 1 + j] * _FACTORS[j]
    return np.unique(mix(runs))
