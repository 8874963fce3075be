"""Word and shingle hashing inside Arrow batches (numpy, 64-bit).

Words are byte strings; ``WordHashes`` keeps a bounded dictionary from word to
its 64-bit hash so that a task hashes each common word once.  A shingle hash
combines n word hashes with odd multipliers and a final mix; sets of shingles
are sorted arrays of distinct 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_CACHE_LIMIT = 200_000


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray | np.uint64) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def multipliers(n: int) -> np.ndarray:
    """n odd 64-bit multipliers, one per position."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each position (len(words) - n + 1 values)."""
    if len(words) < n:
        return np.empty(0, dtype=U64)
    k = multipliers(n)
    out = words[: len(words) - n + 1] * k[0]
    for j in range(1, n):
        out = out + words[j : len(words) - n + 1 + j] * k[j]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words give the whole sequence as one."""
    if len(words) == 0:
        return np.empty(0, dtype=U64)
    if len(words) < n:
        k = multipliers(n)[: len(words)]
        return mix(np.array([(words * k).sum(dtype=U64) + U64(len(words))], dtype=U64))
    return np.unique(gram_hashes(words, n))


def set_id(shingles: np.ndarray) -> int:
    """64-bit identity of a shingle set (order free), as a signed long."""
    total = mix(shingles ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) + U64(len(shingles))
    return int(mix(np.array([total]))[0].astype(np.int64))


def ascii_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z and split on space and 0x09-0x0D, on UTF-8 bytes.

    ``bytes.lower`` and ``bytes.split`` touch exactly those ASCII characters,
    so no multi-byte character is changed or split.
    """
    return text.lower().split()
