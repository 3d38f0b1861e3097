"""Canonical length-limited Huffman codes over integer symbols, in numpy."""

from __future__ import annotations

import numpy as np

#: Longest code in bits, the width of the decoding table's index.
LIMIT = 18
#: Symbols between two bit-offset checkpoints.
STEP = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n == 1:
        out[used] = 1
    if n < 2:
        return out
    if n > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        k = int(leaf[:take].sum())
        out[order[:k]] += 1
        take = 2 * (take - k)
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, then smaller symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        spans = 1 << (self.width - self.lengths[order])
        first = np.cumsum(spans) - spans
        self.codes[order] = (first >> (self.width - self.lengths[order])).astype(np.uint64)
        table = np.zeros(1 << self.width, np.uint32)
        table[: int(spans.sum())] = np.repeat((order.astype(np.uint32) << np.uint32(5)) | self.lengths[order].astype(np.uint32), spans)
        self.table = table

    def encode(self, symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, most significant first, and the bit offset of every STEP-th symbol."""
        if not len(symbols):
            return b"", np.zeros(0, np.uint32)
        size = self.lengths[symbols]
        end = np.cumsum(size)
        at = end - size
        word, room = at >> 6, 64 - (at & 63) - size  # room is negative where a code goes on in the next word
        code = self.codes[symbols]
        out = np.zeros(int(end[-1] + 63 >> 6) + 1, np.uint64)
        over = np.flatnonzero(room < 0)
        part = code << np.maximum(room, 0).astype(np.uint64)
        part[over] = code[over] >> (-room[over]).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(part, first)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(end[-1] + 7) // 8], at[::STEP].astype(np.uint32)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """n symbols; the stretches between checkpoints are decoded side by side."""
        b = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
        at = offsets.astype(np.int64)
        out = np.empty((STEP, len(at)), np.uint32)
        shift, mask, last = np.uint32(32 - self.width), np.uint32(31), len(window) - 1
        for k in range(STEP):
            w = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
            hit = self.table[w >> shift]
            out[k] = hit >> np.uint32(5)
            at += hit & mask
        return out.T.reshape(-1)[:n]
