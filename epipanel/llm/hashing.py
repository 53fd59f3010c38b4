"""64-bit hashes of words and word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from epipanel.llm.common import Memo

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
hash_word = Memo(xxhash.xxh3_64_intdigest, 300_000)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words; of all words if there are fewer."""
    if not tokens:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hash_word.__getitem__, tokens), np.uint64, len(tokens))
    width = min(width, len(own))
    n = len(own) - width + 1
    total = np.full(n, np.uint64(width))
    for i in range(width):
        total = mix(total + own[i:i + n] * _ODD[i % len(_ODD)])
    return total
