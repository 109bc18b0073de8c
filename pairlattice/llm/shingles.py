"""Word shingles of whole texts as 64-bit hashes, computed a text at a time with NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CACHED_WORDS = 100_000


class WordHashes(dict):
    """word -> 64-bit hash; starts anew when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words the whole sequence is the one shingle."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = min(k, n)
    acc = h[: n - m + 1] + np.uint64(m)
    for j in range(1, m):
        acc ^= acc >> np.uint64(29)
        acc *= _ODD
        acc += h[j : n - m + 1 + j]
    acc ^= acc >> np.uint64(32)
    acc *= _MIX
    acc ^= acc >> np.uint64(31)
    acc.sort()
    if len(acc) > 1:
        acc = acc[np.concatenate(([True], acc[1:] != acc[:-1]))]
    return acc
