"""Token links between two tokenizers, by lockstep merging of both token sequences.

A is a byte-level BPE of the tokenizers library on a space and the text, B a
sentencepiece model, which puts the space itself. Both give the same bytes, so each
token ends at a byte offset, and offsets where both end (cuts) divide the text into
groups; every A token of a group is linked with every B token of it.

* Texts are cut where a space stands between two characters that are no white space:
  neither tokenizer ever joins across such a place, so the parts are encoded by
  themselves and what they give is remembered.
* The documents of a chunk are merged in lockstep. The state is a vector with an A and
  a B pointer for each document, or for each LANE bytes of a long one. A step compares
  all the offsets that they point at, emits a cut, with the links that it closes, where
  they are equal, advances the pointers that are not ahead and compacts the vector by
  what is finished.
* How many documents hold an id pair is summed over the corpus: a chunk tells each
  bucket of A ids its distinct pairs with their number of documents; up to GATHER chunks
  are added up at a time, then all. The answers (the pair's count, and whether it
  is its A id's highest) go back the same way, so a pair that every document holds comes once
  a chunk. What a chunk keeps meanwhile are its documents' distinct pairs, as places
  in its own list.

There are at most (ids of A) * (ids of B) pairs, of which a bucket has its part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.llm.bpe import PATTERN, byte_of_char
from rostrum.llm.packed import pack, steps, unpack
from rostrum.plans import scratch

#: Bytes of text in a chunk, about; a longer text is one of its own.
CHUNK = 4 << 20
#: Bytes of a document that one pair of pointers goes through.
LANE = 512
#: Buckets of A ids, and chunks that a task adds up or answers at a time.
BUCKETS, GATHER = 128, 1024
#: Links, or tokens, that are expanded at a time.
SLICE = 1 << 20
#: Parts up to this many characters are remembered, in about so many bytes; each takes some 350 bytes.
LONGEST, KEPT, EACH = 48, 96 << 20, 350
#: New parts that are read as one text.
TOGETHER = 4096

_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Tokenizers:
    """Both tokenizers, the bytes of their ids and the decimal digits of ids."""

    def __init__(self, a_path: str, b_path: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        to_byte = byte_of_char()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = t.encode() if t in special else bytes(map(to_byte.__getitem__, t))
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), n) > 1 << 16:
            raise ValueError("ids need 16 bits")
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x and i not in self.a.get_added_tokens_decoder()}
        #: the same vocabulary, whose ids are in the order of its merges; the bytes of what it gives are compared with the text
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        #: A's and B's ids of parts, in a newer and an older generation
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def learn(self, parts: list[str]) -> None:
        """Put these parts into the memory, read as one text where that is sure to give the same: their ends must be tokens' ends."""
        joined = " ".join(parts)
        raw = b" " + joined.encode()
        a = np.array(self.fast.encode_ordinary(" " + joined), "<u2")
        b = np.array(self.b.encode(joined, num_threads=1), "<u2")
        ends = np.cumsum([len(x.encode()) + 1 for x in parts])
        cuts = []
        for ids, size, text in ((a, self.a_size, self.a_bytes), (b, self.b_size, self.b_bytes)):
            at = np.cumsum(size[ids])
            cut = np.searchsorted(at, ends)
            if at[-1] != len(raw) or (at[cut] != ends).any() or b"".join(map(text.__getitem__, ids.tolist())) != raw:
                return self.learn_singly(parts)
            cuts.append([0, *(2 * cut + 2).tolist()])
        for known, ids, cut in zip(self.known, (a.tobytes(), b.tobytes()), cuts, strict=True):
            known.update(zip(parts, [ids[i:j] for i, j in zip(cut, cut[1:], strict=False)], strict=True))

    def learn_singly(self, parts: list[str]) -> None:
        """Put these parts into the memory; those whose A or B bytes aren't a space and the part among the bad."""
        a = self.a.encode_batch([" " + x for x in parts], add_special_tokens=False)
        b = self.b.encode(parts, num_threads=1)
        for x, i, j in zip(parts, a, b, strict=True):
            i, raw = i.ids, b" " + x.encode()
            if b"".join(map(self.a_bytes.__getitem__, i)) != raw or b"".join(map(self.b_bytes.__getitem__, j)) != raw:
                self.bad.add(x)
            self.known[0][x], self.known[1][x] = np.array(i, "<u2").tobytes(), np.array(j, "<u2").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """A's and B's ids of each text, None if it has no tokens."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        self.bad: set[str] = set()
        every = set(chain.from_iterable(cut))
        (a, b), (older_a, older_b) = self.known, self.older
        new, odd = [], []
        for x in every:
            if x in a:
                continue
            if x in older_a:
                a[x], b[x] = older_a[x], older_b[x]
            elif len(x) <= LONGEST and x.isascii() and not (x[:1].isspace() or x[-1:].isspace()):
                new.append(x)
            else:
                odd.append(x)
        for i in range(0, len(new), TOGETHER):
            self.learn(new[i : i + TOGETHER])
        inner = [x for x in odd if x[:1].strip() and x[-1:].strip() and len(x) <= LONGEST]
        for i in range(0, len(inner), TOGETHER // 8):
            self.learn(inner[i : i + TOGETHER // 8])
        self.learn_singly([x for x in odd if x not in a])
        out = []
        for parts in cut:
            whole = parts and (not self.bad or self.bad.isdisjoint(parts))
            out.append((b"".join(map(a.__getitem__, parts)), b"".join(map(b.__getitem__, parts))) if whole else None)
        for x in self.bad.union(x for x in odd if len(x) > LONGEST):
            del a[x], b[x]
        if len(a) * EACH > KEPT // 2:  # what is often asked for comes back from the older generation
            self.known, self.older = ({}, {}), self.known
        return out


@lru_cache(1)
def _read(a_path: str, b_path: str) -> _Tokenizers:
    """Both vocabularies, read once in each Python worker; what is remembered ends with its task."""
    return _Tokenizers(a_path, b_path)


@lru_cache(1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Of each 16-bit id: five decimal digits as ASCII, and which of them count."""
    i = np.arange(1 << 16)
    d = np.stack([i // 10**k % 10 for k in (4, 3, 2, 1, 0)], 1)
    shown = np.stack([i >= 10**k if k else i >= 0 for k in (4, 3, 2, 1, 0)], 1)
    return (d + 48).astype(np.uint8), shown


def lockstep(a_end: np.ndarray, b_end: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cuts: tokens of A and of B, ascending, that end at the same offset.

    Offsets are ascending over all documents; limits are the documents' ends, which both sequences have.
    """
    size = np.diff(limits, prepend=0)
    lanes = -(-size // LANE)
    at = np.repeat(limits - size, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    limit = np.minimum(at + LANE, np.repeat(limits, lanes))
    i, j = np.searchsorted(a_end, at, "right"), np.searchsorted(b_end, at, "right")
    beyond = np.iinfo(np.int64).max
    a_end, b_end = np.r_[a_end, beyond], np.r_[b_end, beyond]
    a_cuts, b_cuts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        x, y = a_end[i], b_end[j]
        going = np.maximum(x, y) <= limit
        if not going.all():
            i, j, x, y, limit = i[going], j[going], x[going], y[going], limit[going]
        same = x == y
        a_cuts.append(i[same])
        b_cuts.append(j[same])
        i = i + (x <= y)
        j = j + (y <= x)
    a, b = np.concatenate(a_cuts), np.concatenate(b_cuts)
    a.sort()
    b.sort()
    return a, b


def _slices(weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with a weight of about SLICE each."""
    total = np.cumsum(weight)
    at = 0
    while at < len(weight):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        yield at, to
        at = to


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with the sum of their counts."""
    if not len(keys):
        return keys, counts
    o = np.argsort(keys)
    keys, counts = keys[o], counts[o]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class _Groups:
    """Groups of a chunk: ids a, b; first tokens and numbers of tokens; the document of each group."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, doc: np.ndarray):
        self.a, self.b, self.doc = a, b, doc
        self.na, self.nb = np.diff(a_cut, prepend=-1), np.diff(b_cut, prepend=-1)
        self.fa, self.fb = a_cut + 1 - self.na, b_cut + 1 - self.nb

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, A id, B id) as one number each, ascending, and how many links each stands for."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        many = self.na * self.nb
        large = np.flatnonzero(many > SLICE)
        few = np.where(many > SLICE, 0, many)
        for g0, g1 in _slices(few):
            k = few[g0:g1]
            g = np.repeat(np.arange(g0, g1), k)
            r = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
            i, j = np.divmod(r, self.nb[g])
            key, n = np.unique(self.doc[g] << 32 | self.a[self.fa[g] + i].astype(np.int64) << 16 | self.b[self.fb[g] + j], return_counts=True)
            keys.append(key)
            counts.append(n)
        for g in large.tolist():  # its distinct ids, with the product of how often they come
            x, nx = np.unique(self.a[self.fa[g] : self.fa[g] + self.na[g]], return_counts=True)
            y, ny = np.unique(self.b[self.fb[g] : self.fb[g] + self.nb[g]], return_counts=True)
            keys.append((self.doc[g] << 32 | x.astype(np.int64)[:, None] << 16 | y).ravel())
            counts.append((nx[:, None] * ny).ravel())
        return _added(np.concatenate(keys), np.concatenate(counts))

    def digests(self, docs: int) -> list[bytes]:
        """SHA-256 of each document's groups as text; b"" where there are none."""
        digits, shown = _digits()
        sha = [None] * docs
        ends = np.r_[self.doc[1:] != self.doc[:-1], True] if len(self.doc) else np.zeros(0, bool)
        for g0, g1 in _slices(self.na + self.nb):
            na, nb = self.na[g0:g1], self.nb[g0:g1]
            ta, tb = int(na.sum()), int(nb.sum())
            before_a, before_b = np.cumsum(na), np.cumsum(nb) - nb
            at_a = np.arange(ta) + np.repeat(before_b, na)
            at_b = np.arange(tb) + np.repeat(before_a, nb)
            ids = np.empty(ta + tb, np.int64)
            ids[at_a] = self.a[self.fa[g0] : self.fa[g0] + ta]
            ids[at_b] = self.b[self.fb[g0] : self.fb[g0] + tb]
            last_a, last_b = at_a[np.cumsum(na) - 1], at_b[np.cumsum(nb) - 1]
            text, show = np.full((ta + tb, 6), ord(","), np.uint8), np.ones((ta + tb, 6), bool)
            text[:, :5], show[:, :5] = digits[ids], shown[ids]
            text[last_a, 5] = ord("|")
            text[last_b, 5] = ord(";")
            show[last_b[ends[g0:g1]], 5] = False
            raw = memoryview(text[show].tobytes())
            end = np.cumsum(show.sum(1))[last_b]
            doc = self.doc[g0:g1]
            stop = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
            at = 0
            for d, to in zip(doc[stop].tolist(), end[stop].tolist(), strict=True):
                sha[d] = sha[d] or hashlib.sha256()
                sha[d].update(raw[at:to])
                at = to
        return [x.digest() if x else b"" for x in sha]


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
_OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("asked", pa.binary()), ("held", pa.binary())])
_ASKED_SQL = "chunk long, bucket int, asked binary, held binary"


def _chunk(n: int, ids: list[int | None], texts: list[str], both: _Tokenizers) -> pa.RecordBatch:
    """A row without a bucket for what the chunk keeps, and a row for each bucket that its pairs fall into."""
    tokens = both.encode(texts)
    count = len(ids)
    a = np.frombuffer(b"".join([x[0] for x in tokens if x]), "<u2")
    b = np.frombuffer(b"".join([x[1] for x in tokens if x]), "<u2")
    n_a, n_b = (np.array([len(x[k]) // 2 if x else 0 for x in tokens], np.int64) for k in (0, 1))
    a_end, b_end = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    some = np.flatnonzero(n_a)
    a_cut, b_cut = lockstep(a_end, b_end, a_end[np.cumsum(n_a[some]) - 1])
    doc = some[np.searchsorted(np.cumsum(n_a[some]), a_cut, "right")] if len(some) else some
    groups = _Groups(a, b, a_cut, b_cut, doc)
    n_groups = np.bincount(doc, minlength=count)
    n_links = np.zeros(count, np.int64)
    np.add.at(n_links, doc, groups.na * groups.nb)
    key, times = groups.links()
    pair, nth, holds = np.unique(key & 0xFFFFFFFF, return_inverse=True, return_counts=True)
    bucket = (pair >> 16) % BUCKETS
    o = np.argsort(bucket, kind="stable")
    place = np.empty(len(o), np.int64)
    place[o] = np.arange(len(o))
    pair, holds, bucket = pair[o], holds[o], bucket[o]
    # each document's pairs by their place in the order asked
    by = (key >> 32) << 32 | place[nth]
    o = np.argsort(by)
    doc, by, times = key[o] >> 32, by[o] & 0xFFFFFFFF, times[o]
    gaps = np.where(np.r_[True, doc[1:] != doc[:-1]], by, np.diff(by, prepend=0)) if len(by) else by
    sha = groups.digests(count)
    kept = pack(
        np.array([0 if i is None else i for i in ids], "<i8"),
        np.array([i is None for i in ids], np.uint8),
        *(x.astype("<i8") for x in (n_a, n_b, n_groups, n_links)),
        np.array([len(x) for x in sha], np.uint8),
        np.frombuffer(b"".join(sha), np.uint8),
        np.bincount(doc, minlength=count).astype("<u4"),
        gaps.astype("<u4"),
        times.astype("<u8"),
    )
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
    ends = [*cut[1:].tolist(), len(bucket)] if len(bucket) else []
    asked = [pack(steps(pair[i:j].astype("<u4")), holds[i:j].astype("<u4")) for i, j in zip(cut.tolist(), ends, strict=True)]
    m = len(asked)
    return pa.RecordBatch.from_arrays([pa.array([n] * (m + 1), pa.int64()), pa.array([None, *bucket[cut].tolist()], pa.int32()), pa.array([None, *asked], pa.binary()), pa.array([kept] + [None] * m, pa.binary())], schema=_ASKED)


def _tokenise(a_path: str, b_path: str):
    """(id, text) in; rows of chunks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _read(a_path, b_path)
        both.forget()
        n, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                if ids and size + len(t) > CHUNK:
                    yield _chunk(n, ids, texts, both)
                    n, size, ids, texts = n + 1, 0, [], []
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield _chunk(n, ids, texts, both)
        both.forget()

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of a bucket with the documents of these chunks that hold them."""
    pairs, holds = [], []
    for x in table["asked"]:
        gaps, n = unpack(x.as_py(), "<u4", "<u4")
        pairs.append(np.cumsum(gaps, dtype=np.int64))
        holds.append(n.astype(np.int64))
    pair, n = _added(np.concatenate(pairs), np.concatenate(holds))
    return pa.table({"pair": pa.array(pair, pa.int64()), "n": pa.array(n, pa.int64())})


def _answer(key: tuple[pa.Scalar, ...], asked: pa.Table, counts: pa.Table) -> pa.Table:
    """For each row of these chunks: the counts of its pairs, and which are their A id's highest."""
    pair, n = counts["pair"].to_numpy(), counts["n"].to_numpy()
    o = np.argsort(pair)
    pair, n = pair[o], n[o]
    a = pair >> 16
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
    top = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(a)])) if len(a) else n
    out = []
    for x in asked["asked"]:
        at = np.searchsorted(pair, np.cumsum(unpack(x.as_py(), "<u4", "<u4")[0], dtype=np.int64))
        out.append(pack(n[at].astype("<u8"), (n[at] == top[at]).astype(np.uint8)))
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "answer": pa.array(out, pa.binary())})


def _result(id_col: str):
    """Chunks with their answers in, a row a document out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held, answers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, null, n_a, n_b, n_groups, n_links, size, sha, many, gaps, times = unpack(held, "<i8", "u1", "<i8", "<i8", "<i8", "<i8", "u1", "u1", "<u4", "<u4", "<u8")
                told = [unpack(x["answer"], "<u8", "u1") for x in sorted(answers or [], key=lambda x: x["bucket"])]
                count = np.concatenate([np.zeros(0, np.int64), *(x[0].astype(np.int64) for x in told)])
                best = np.concatenate([np.zeros(0, np.int64), *(x[1].astype(np.int64) for x in told)])
                doc = np.repeat(np.arange(len(ids)), many)
                first = np.cumsum(many, dtype=np.int64) - many
                at = np.cumsum(gaps, dtype=np.int64)
                at -= np.repeat((at - gaps)[np.minimum(first, max(0, len(at) - 1))] if len(at) else first, many)
                sums = np.zeros((2, len(ids)), np.int64)
                np.add.at(sums[0], doc, best[at] * times.astype(np.int64))
                np.add.at(sums[1], doc, count[at] * times.astype(np.int64))
                end = np.cumsum(size, dtype=np.int64)
                raw = sha.tobytes()
                shas = [raw[e - s : e].hex() for e, s in zip(end.tolist(), size.tolist(), strict=True)]
                cols = [pa.array(ids, pa.int64(), mask=null.astype(bool)), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links, *sums)), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *_COLUMNS, "n_best", "count_sum", "groups_sha256"])

    return run


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens don't give a space and the text back
    (U+2581 in it), have no tokens: zeros and ''. Each row is a document of its own in the
    counts, whatever its id; ids are long integers or null. Other columns are
    ignored; an empty table gives an empty result. Both vocabularies must lie at the
    same path on every executor.
    """
    return scratch.settle(docs.sparkSession, lambda: _linked(docs, a_path, b_path, id_col, text_col), "links")


def _linked(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    arrow.bound(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = scratch.keep(texts.mapInArrow(_tokenise(a_path, b_path), _ASKED_SQL), "tokens", "uncompressed")
    held = made.where("bucket IS NULL").select("chunk", "held")
    parts = 1 + held.count() // GATHER
    asked = made.where("bucket IS NOT NULL").select("chunk", "bucket", "asked", F.pmod(F.xxhash64("chunk"), F.lit(parts).cast("long")).alias("part"))
    counts = asked.groupBy("bucket", "part").applyInArrow(_add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts").select("pair", "n", (F.shiftright("pair", 16) % BUCKETS).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    answers = asked.groupBy("bucket", "part").cogroup(counts.groupBy("bucket", "part")).applyInArrow(_answer, "chunk long, bucket int, answer binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return held.join(answers, "chunk", "left").select("held", "answers").mapInArrow(_result(id_col), f"`{id_col}` long, {_OUT}")
