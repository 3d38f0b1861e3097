"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is what the merges give exactly when every two neighbours are
compatible: no merge across their boundary would come before the merges that
consume the pieces beside it. So a piece is encoded left to right with the longest
token that an Aho-Corasick automaton finds at each place; where a token is
not compatible with the one before it, its longest proper prefix that is a token is
tried, and where none is left, the place is marked dead and the token before gives
way. Each place dies once, so the work is linear in the piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.llm.memo import Memo

#: Bytes of pieces, and number of pairs of tokens (some 100 bytes each), that a worker remembers.
KEPT_PIECES, KEPT_PAIRS = 48 << 20, 200_000

# Fixed value: the pattern by which byte-level BPE vocabularies cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        raw = {t: bytes(map(to_byte.__getitem__, t)) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.text = [b""] * size
        for t, i in self.ids.items():
            self.text[i] = t
        for t, i in self.special.items():
            self.text[i] = t.encode()
        self.rank: dict[int, int] = {}
        self.parts = np.full((size, 2), -1, np.int32)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, made = self.ids[raw[a]], self.ids[raw[b]], self.ids[raw[a] + raw[b]]
            self.rank[x * size + y] = r
            if self.parts[made, 0] < 0:
                self.parts[made] = x, y
        self.finder = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.finder.add_word(t.decode("latin-1"), (len(t), i))
        self.finder.make_automaton()
        self.shorter = [-1] * size
        for t, i in self.ids.items():
            self.shorter[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
        self.lengths = list(map(len, self.text))
        self.size = np.array(self.lengths, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.cut = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pieces = Memo(self._piece, KEPT_PIECES)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that lie at a token's right (1) or left (0) edge while it is merged, each with the rank that consumes it."""
        known = self.edges[side].get(token)
        if known is None:
            known = [(token, float("inf"))]
            size, part = len(self.text), token
            while (xy := self.parts[part].tolist())[0] >= 0:
                part = xy[side]
                known.append((part, self.rank[xy[0] * size + xy[1]]))
            self.edges[side][token] = known  # at most two short lists an id
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a boundary between tokens a and b."""
        size = len(self.text)
        known = self.pairs.get(a * size + b)
        if known is None:
            known, rank, right = True, self.rank.get, self._edge(b, 0)
            for x, x_ends in self._edge(a, 1):
                row = x * size
                for y, y_ends in right:
                    r = rank(row + y)
                    # of equal merges the leftmost comes first
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a * size + b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        if (whole := self.ids.get(piece)) is not None:
            return [whole]  # the longest match at the first place
        longest = [-1] * n
        for end, (size, token) in self.finder.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # a longer one from this place ends later
        dead = bytearray(n + 1)
        pair, shorter, lengths, many = self.pairs.get, self.shorter, self.lengths, len(self.text)
        out: list[int] = []
        at, before, token = 0, -1, longest[0] if n else -1
        while at < n:
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                before = out[-1] if out else -1
            elif not dead[at + lengths[token]]:
                fits = before < 0 or pair(before * many + token)
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    at += lengths[token]
                    before, token = token, longest[at] if at < n else -1
                    continue
            token = shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))
        out = []
        for k, part in enumerate(self.at_special.split(text)):
            out.append(self.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(self.pieces.__getitem__, self.cut.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become replacement characters, as in the library."""
        i = np.frombuffer(ids, "<u4")
        size = self.size[i]
        end = np.cumsum(size)
        n = int(end[-1]) if len(end) else 0
        at = np.repeat(self.start[i] - (end - size), size) + np.arange(n)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(1)
def load(path: str) -> Bpe:
    """The vocabulary, read once in each Python worker, with what the worker remembers of pieces."""
    return Bpe(path)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    Null text is as empty: no tokens, and the digests of nothing. Special tokens'
    strings in a text become their ids, as the library does by default. Repeated
    rows, null ids and other columns change nothing; an empty table gives an
    empty result. The vocabulary must lie at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    arrow.bound(docs.sparkSession)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
