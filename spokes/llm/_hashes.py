"""64-bit hashes of words and word windows, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from spokes.llm._arrow import Memo

#: Odd multipliers of the window hashes; two of them give independent keys.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() cuts at the six ASCII white spaces alone."""
    return (text or "").encode("utf-8", "replace").split()


@lru_cache(maxsize=1)
def word_memo() -> Memo:
    """One for all tasks of a Python worker."""
    return Memo(xxhash.xxh64_intdigest)


def word_hashes(memo: Memo, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose order is unlike theirs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """Hash of each window of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASES[base]) + h[k : k + n]
    return mix(out)
