"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word is a maximal run of ASCII letters and digits and of all characters beyond ASCII, in lower case. Its hash is that
of its UTF-8 bytes alone: the difference of two prefix sums of byte * BASE**position (mod 2**64), shifted back by the
inverse power and mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WORD = np.zeros(256, bool)
WORD[128:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    WORD[ord(_a) : ord(_b) + 1] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the texts in them; a null is an empty text."""
    text = pc.fill_null(text, "")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32, n + 1, text.offset * 4).astype(np.int64)
    data = text.buffers()[2]
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes (uint64), starts and ends (byte positions in the lower-case text of the batch), and, for document i, words
    offsets[i] to offsets[i + 1]."""
    b, offsets = buffer(pc.utf8_lower(text) if lower else text)
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = WORD[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] |= inside[cut]
    cut = cut[cut > 0]
    last[cut - 1] |= inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = powers(n)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:n], out=h[1:])
    return mix((h[e] - h[s]) * q[s]), s, e, np.searchsorted(s, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, len(hashes) - k + 1 of them; the caller leaves out those that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += hashes[i : n + i]
    return mix(out)


def of_text(text: str | None) -> np.ndarray:
    return words(pa.array([text], pa.string()))[0]
