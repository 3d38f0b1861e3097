"""Arrays in one binary column."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each byte plane by itself so that leading zeros vanish."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        parts += [np.array([len(a), a.itemsize], "<u4").tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays that pack() got, whose types are these."""
    raw, at, out = zstandard.decompress(packed), 0, []
    for kind in kinds:
        n, size = np.frombuffer(raw, "<u4", 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 8 + n * size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first from 0; cumsum gives the array back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))
