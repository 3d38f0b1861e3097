"""Word shingles as 64-bit hashes, computed in numpy on whole UTF-8 texts."""

from __future__ import annotations

import numpy as np
import xxhash

from rostrum.llm.memo import Memo

WIDTH = 5
#: Bytes of words and their hashes that a task remembers.
KEPT_WORDS = 24 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes() -> Memo:
    """The hashes of words, for one task."""
    return Memo(xxhash.xxh64_intdigest, KEPT_WORDS)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _Q
    h ^= h >> np.uint64(32)
    return h


def shingle_hashes(text: bytes, width: int = WIDTH, known: Memo | None = None) -> np.ndarray:
    """Hashes of the text's word shingles in text order, repeats included.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+, which is how bytes.split()
    splits. Fewer words than the width make one shingle; none make none.
    """
    words = text.lower().split()
    n = len(words)
    known = word_hashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if not n:
        return h
    k = min(n, width)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= _P
        out += h[i : n - k + 1 + i]
    if n < width:
        out += np.uint64(n)  # a short text is another shingle than the same words inside a long one
    return _mix(out)


def shingle_set(text: bytes, width: int = WIDTH, known: Memo | None = None) -> np.ndarray:
    """The distinct hashes, ascending."""
    h = shingle_hashes(text, width, known)
    h.sort()
    if len(h) > 1:
        h = h[np.r_[True, h[1:] != h[:-1]]]
    return h


def set_id(h: np.ndarray, nth: int = 0) -> int:
    """A signed 64-bit name of a set; for each nth another one."""
    x = xxhash.xxh64_intdigest(h.tobytes(), seed=len(h) + (nth << 40))
    return x - (1 << 64) if x >> 63 else x
