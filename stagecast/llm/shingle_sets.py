"""Word-shingle sets of texts as sorted arrays of 64-bit hashes (numpy, inside tasks).

Words are ``bytes.lower().split()``: A-Z lower-cased, cut at ASCII white space. A set holds the hash of
each distinct run of ``width`` words; a text with fewer words has one run, the whole sequence; a text
without words has an empty set. Word hashes are kept in a dictionary of bounded size by each worker.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd constants of the multiply-and-shift mixing below.
MULTIPLIER, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORDS_KEPT = 250_000
_WORD_HASHES: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _WORD_HASHES
    for w in set(words).difference(known):
        if len(known) >= WORDS_KEPT:
            known.clear()
            return word_hashes(words) if len(set(words)) < WORDS_KEPT else np.array(
                [xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text (uint64)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    runs = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        total = np.full(runs, np.uint64(min(width, len(h))))
        for j in range(min(width, len(h))):
            total = mixed(total * MULTIPLIER + h[j:j + runs])
    return np.unique(total)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
