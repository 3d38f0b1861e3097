"""Removal of passages that an earlier document has, by level-wise doubling of repeated windows.

A window of 13 words can repeat in another document only if the two windows of 7
words that make it up do (13 = 2 * 7 - 1). So windows of the least length are counted
over the whole corpus, those that no other document has are dropped, what is left is
extended to twice that length (less one where the full length asks for it), and so
on until no candidate is left or the full length is reached. Each level looks
at what survived the level before alone; a document without a candidate is done.

How a level is counted without a row a window: documents are packed into chunks, and a
chunk asks each bucket of the hash space with one row, the ascending hashes of its
candidates there, each once however often the chunk has it. So a passage that a
third of all documents share reaches its bucket once a chunk. A bucket holds the
rows of all chunks against each other and answers each with a bit a hash; the
answers meet their chunk again, whose texts give the same hashes in the same order.

Levels below the last only decide what to extend, so 28 bits of a hash inside its
bucket do. The last level has whole 64-bit hashes with the least id of a document
of the chunk that has it, and its bit says whether another chunk has the hash in a
document with a smaller id. Two different windows are taken as equal only if their 64-bit
hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.llm.memo import Memo
from rostrum.llm.packed import pack, steps, unpack
from rostrum.llm.shingles import word_hashes
from rostrum.plans import scratch

WIDTH = 13
#: The first level's windows have fewer words than this.
FIRST = 8
#: Bytes of text in a chunk, about; a longer text is one of its own.
CHUNK = 6 << 20
#: Bytes of text for a bucket, and the most buckets: beyond (1 TB) they grow with the text, 8 to 24 bytes a window.
BUCKET, BUCKETS = 16 << 20, 1 << 16
#: Bits of a hash inside its bucket, on levels below the last.
SHORT = 28
#: Stands for a null id: no id is greater.
NO_ID = (1 << 63) - 1

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def lengths(width: int) -> list[int]:
    """The window lengths of the levels, ascending: each is twice the one before, or one less."""
    out = [width]
    while out[0] >= FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Chunk:
    """Documents: ids (NO_ID for null), words, n_words and n_removed, digest of what is done; alive says which words begin a candidate."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.texts = texts
        self.done = [b""] * len(ids)
        self.n = np.zeros(len(ids), np.int64)
        self.alive: np.ndarray | None = None  # of the words of what is not done

    def pack(self) -> bytes:
        left = [b" ".join(self.words[k]) if not d else b"" for k, d in enumerate(self.done)]
        parts = [np.array([len(self.ids)], "<u4").tobytes(), self.ids.astype("<i8").tobytes(), self.n.astype("<i8").tobytes(), np.array(list(map(len, left)), "<i8").tobytes(), b"".join(d or bytes(32) for d in self.done), np.array([not d for d in self.done], np.uint8).tobytes()]
        alive = b"" if self.alive is None else np.packbits(self.alive).tobytes()
        return zstandard.compress(b"".join([*parts, np.array([len(alive)], "<u4").tobytes(), alive, *left]), 1)

    @staticmethod
    def unpack(packed: bytes) -> _Chunk:
        raw = zstandard.decompress(packed)
        m = int(np.frombuffer(raw, "<u4", 1)[0])
        ids, n, sizes = np.frombuffer(raw, "<i8", 3 * m, 4).reshape(3, m)
        at = 4 + 24 * m
        shas = raw[at : at + 32 * m]
        left = np.frombuffer(raw, np.uint8, m, at + 32 * m).astype(bool).tolist()
        at += 33 * m
        k = int(np.frombuffer(raw, "<u4", 1, at)[0])
        alive = np.frombuffer(raw, np.uint8, k, at + 4)
        at += 4 + k
        out = _Chunk([], [])
        out.ids, out.n = ids, n.copy()
        out.done = [b"" if left[i] else shas[32 * i : 32 * i + 32] for i in range(m)]
        for size in sizes.tolist():
            out.texts.append(raw[at : at + size])
            at += size
        out.alive = np.unpackbits(alive).astype(bool) if k else None
        return out

    def split(self) -> None:
        """Words of what is not done, and for each of them its document and the words from it to the document's end."""
        self.words = [[] if d else t.split() for t, d in zip(self.texts, self.done, strict=True)]
        self.sizes = np.array(list(map(len, self.words)), np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.room = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.doc))
        if self.alive is not None:
            self.alive = self.alive[: len(self.doc)]

    def hashes(self, length: int, known: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Places of the candidate windows of this length, and their hashes."""
        w = np.fromiter((x for ws in self.words for x in map(known.__getitem__, ws)), np.uint64, len(self.doc))
        at = np.flatnonzero(self.room >= length if self.alive is None else (self.room >= length) & self.alive)
        h = w[at]
        for i in range(1, length):
            h *= _P
            h += w[at + i]
        h ^= h >> np.uint64(29)
        h *= _Q
        h ^= h >> np.uint64(32)
        return at, h

    def finish(self, k: int, stays: np.ndarray | None = None) -> None:
        """What is known of document k: its words stay, but those where stays is false."""
        words = self.words[k]
        kept = words if stays is None else list(compress(words, stays.tolist()))
        self.n[k] = len(words) | (len(words) - len(kept)) << 32
        self.done[k] = hashlib.sha256(b" ".join(kept)).digest()


def _distinct(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes, the number of each window's among them, and the least and greatest id of each."""
    o = np.argsort(h)
    s = h[o]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    nth = np.empty(len(h), np.int64)
    nth[o] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(s)]))
    if not len(h):
        return s, nth, ids, ids
    return s[first], nth, np.minimum.reduceat(ids[o], first), np.maximum.reduceat(ids[o], first)


def _names(chunk: _Chunk, length: int, last: bool, buckets: int, known: Memo):
    """Candidate places; bucket and name of each distinct hash in the order asked, least and greatest ids, and each window's number in that order."""
    at, h = chunk.hashes(length, known)
    bucket = h % np.uint64(buckets)
    if not last:
        h = bucket << np.uint64(SHORT) | h >> np.uint64(64 - SHORT)
    names, nth, least, most = _distinct(h, chunk.ids[chunk.doc[at]])
    bucket = names >> np.uint64(SHORT) if not last else names % np.uint64(buckets)
    o = np.argsort(bucket, kind="stable")
    back = np.empty(len(o), np.int64)
    back[o] = np.arange(len(o))
    return at, bucket[o].astype(np.int64), names[o], least[o], most[o], back[nth]


_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("asked", pa.binary()), ("held", pa.binary())])
_ASKED_SQL = "chunk long, bucket int, asked binary, held binary"


def _ask(n: int, chunk: _Chunk, length: int, last: bool, buckets: int, known: Memo) -> pa.RecordBatch:
    """A row without a bucket for the chunk itself, and one for each bucket that its candidates fall into."""
    _, bucket, names, least, _, _ = _names(chunk, length, last, buckets, known)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
    asked = []
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=len(bucket) > 0):
        own = names[i:j]
        if not last:
            asked.append(pack(steps((own & np.uint64((1 << SHORT) - 1)).astype("<u4"))))
        else:
            ids, nth = np.unique(least[i:j], return_inverse=True)
            asked.append(pack(steps(own), ids, nth.astype("<u4")))
    m = len(asked)
    return pa.RecordBatch.from_arrays([pa.array([n] * (m + 1), pa.int64()), pa.array([None, *bucket[cut].tolist()], pa.int32()), pa.array([None, *asked], pa.binary()), pa.array([chunk.pack()] + [None] * m, pa.binary())], schema=_ASKED)


def _first(length: int, last: bool, buckets: int):
    """(id, text) in; chunks and what they ask out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        n, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []

        def chunk() -> pa.RecordBatch:
            c = _Chunk(ids, texts)
            c.split()
            return _ask(n, c, length, last, buckets, known)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and size + len(t) > CHUNK:
                    yield chunk()
                    n, size, ids, texts = n + 1, 0, [], []
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                size += len(t)
        if ids:
            yield chunk()

    return run


def _answer(last: bool):
    """All rows of a bucket in; for each a bit a hash: whether another chunk has it, on the last level with a smaller id."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, ids = [], []
        for a in table["asked"]:
            if not last:
                names.append(np.cumsum(unpack(a.as_py(), "<u4")[0], dtype=np.uint32))
            else:
                gaps, known, nth = unpack(a.as_py(), "<u8", "<i8", "<u4")
                names.append(np.cumsum(gaps, dtype=np.uint64))
                ids.append(known[nth])
        x = np.concatenate(names)
        o = np.argsort(x, kind="stable")
        s = x[o]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        many = np.diff(np.r_[first, len(s)])
        bit = np.empty(len(x), bool)
        if not last:
            bit[o] = np.repeat(many > 1, many)
        else:
            y = np.concatenate(ids)
            bit[o] = np.repeat(np.minimum.reduceat(y[o], first), many) < y[o]
        ends = np.cumsum(list(map(len, names)))
        bits = [np.packbits(bit[e - len(n) : e]).tobytes() for n, e in zip(names, ends.tolist(), strict=True)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def _extend(length: int, longer: int, last: bool, buckets: int):
    """Chunks with the answers to their windows of this length in; chunks with the candidates for the longer ones, and what they ask, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for b in batches:
            for n, chunk, at, _, least, most, nth, bits in _answered(b, length, False, buckets, known):
                alive = np.zeros(len(chunk.doc), bool)
                alive[at] = (bits | (least < most))[nth]
                both = np.zeros(len(alive), bool)
                first = max(0, len(alive) - (longer - length))
                both[:first] = alive[:first] & alive[len(alive) - first :]
                chunk.alive = both & (chunk.room >= longer)
                _settle(chunk, np.unique(chunk.doc[chunk.alive]))
                yield _ask(n, chunk, longer, last, buckets, known)

    return run


def _settle(chunk: _Chunk, candidates: np.ndarray) -> None:
    """Documents without a candidate are done."""
    left = np.zeros(len(chunk.ids), bool)
    left[candidates] = True
    for k in np.flatnonzero(~left).tolist():
        if not chunk.done[k]:
            chunk.finish(k)
    keep = left[chunk.doc]
    chunk.words = [w if x else [] for w, x in zip(chunk.words, left.tolist(), strict=True)]
    chunk.alive, chunk.doc, chunk.room = chunk.alive[keep], chunk.doc[keep], chunk.room[keep]


def _answered(b: pa.RecordBatch, length: int, last: bool, buckets: int, known: Memo):
    """Each chunk of a batch with its windows and the bit of each distinct hash."""
    for n, held, answers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
        chunk = _Chunk.unpack(held)
        chunk.split()
        at, bucket, names, least, most, nth = _names(chunk, length, last, buckets, known)
        bits = np.zeros(len(bucket), bool)
        for a in answers or []:
            i, j = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1]).tolist()
            bits[i:j] = np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: j - i]
        yield n, chunk, at, names, least, most, nth, bits


def _remove(width: int, buckets: int, id_col: str):
    """Chunks with the answers to their windows of full length in; the result's rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for b in batches:
            for _, chunk, at, _, least, _, nth, bits in _answered(b, width, True, buckets, known):
                gone = at[bits[nth] | (chunk.ids[chunk.doc[at]] > least[nth])]
                edge = np.zeros(len(chunk.doc) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + width, -1)
                stays = np.cumsum(edge)[:-1] == 0
                ends = np.cumsum(chunk.sizes)
                for k in [k for k, d in enumerate(chunk.done) if not d]:
                    chunk.finish(k, stays[ends[k] - chunk.sizes[k] : ends[k]])
                cols = [pa.array(chunk.ids, pa.int64(), mask=chunk.ids == NO_ID), pa.array(chunk.n & 0xFFFFFFFF, pa.int64()), pa.array(chunk.n >> 32, pa.int64()), pa.array([d.hex() for d in chunk.done], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return run


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if it lies in a window of `width` words that also begins in a document
    with a smaller id; all windows are those of the input. Words are what lies between
    ASCII white space, unchanged. Null and empty texts have none, and the digest of
    nothing. Rows that share an id take nothing from each other; a null id is
    greater than any other, and null ids take nothing from each other. Ids are long
    integers. Other columns are ignored; an empty table gives an empty result.
    """
    return scratch.settle(docs.sparkSession, lambda: _removed(docs, id_col, text_col, width), "kept")


def _removed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    arrow.bound(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(BUCKETS, 1 + size // BUCKET)
    levels = lengths(width)
    made = scratch.keep(texts.mapInArrow(_first(levels[0], len(levels) == 1, buckets), _ASKED_SQL), "windows", "uncompressed")
    for k, length in enumerate(levels):
        last = k == len(levels) - 1
        answers = made.where("bucket IS NOT NULL").select("chunk", "bucket", "asked").groupBy("bucket").applyInArrow(_answer(last), "chunk long, bucket int, bits binary")
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
        met = made.where("bucket IS NULL").select("chunk", "held").join(answers, "chunk", "left").select("chunk", "held", "answers")
        if last:
            return met.mapInArrow(_remove(width, buckets, id_col), f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string")
        before, made = made, scratch.keep(met.mapInArrow(_extend(length, levels[k + 1], k == len(levels) - 2, buckets), _ASKED_SQL), "windows", "uncompressed")
        scratch.drop(before)
