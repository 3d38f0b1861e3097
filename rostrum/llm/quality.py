"""Quality classifier from weak labels.

Overlapping heuristic labellers each name a document junk or abstain. Expectation-
maximisation over the counts of their vote patterns (at most 2^labellers rows,
whatever the corpus) estimates how often each fires on clean and on junk documents
and the share of clean ones; no gold label is used. The posteriors then label a bounded
sample on which a hashed linear scorer is trained, and that scores every document.

The scorer's features are hashed: words, pairs of neighbouring words, shapes of words
(runs of letters and digits as one character), words that repeat the one before, and
five words in a row that came before. The last two are what the labellers "stutter"
and "loops" count; the scorer does not see what the other seven do.

Two passes over the texts: one counts vote patterns and takes the sample, one scores.
Both work on the code points of many texts at once, without a table of words.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.plans import scratch

#: Documents that the scorer is trained on at most, chosen by a hash of id and text, and the most words of one of them.
SAMPLE, SAMPLE_WORDS = 4_000, 1_000
BITS = 18
DIM = 1 << BITS
#: A document is kept from this score (probability of being clean) on.
KEEP = 0.5
EM_ROUNDS, EPOCHS = 50, 12
#: Code points looked at together, about; a longer text is looked at alone.
TOGETHER = 200_000

LABELLERS = ("decorated", "symbols", "shouting", "exclaiming", "bare", "fragments", "stutter", "monotone", "loops")

SPACE, LOWER, UPPER, DIGIT, WORDLIKE, PLAIN, BANG, OPENS, CLOSES, SYMBOL = range(10)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Seeds that tell kinds of features apart.
WORD, PAIR, SHAPE, AGAIN, BEFORE = (np.uint64(x) for x in (1, 2, 3, 4, 5))


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = unicodedata.category(chr(i))
        if c == "Lu":
            out[i] = UPPER
        elif c[0] in "LM":
            out[i] = LOWER
        elif c == "Nd":
            out[i] = DIGIT
        elif c[0] == "N":
            out[i] = WORDLIKE
        elif chr(i).isspace():
            out[i] = SPACE
    for chars, kind in (("_", WORDLIKE), (".,;:?", PLAIN), ("!", BANG), ("(«“‘", OPENS), (")]\"'»”’…-", CLOSES)):
        out[[ord(x) for x in chars]] = kind
    return out


class _Powers:
    """Powers of an odd base and of its inverse, for hashes of parts of an array by differences of one running sum."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    def parts(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, _ = self(len(x))
        sums = np.r_[np.uint64(0), np.cumsum(x * up, dtype=np.uint64)]
        _, down = self(len(x) + 1)
        return _spread((sums[end] - sums[start]) * down[start])


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def _bucket(h: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (((h + kind) * _P ^ h >> np.uint64(17)) * _Q >> np.uint64(64 - BITS)).astype(np.int64)


def _first(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether an entry is the first of its hash in its document."""
    out = np.zeros(len(h), bool)
    if len(h):
        key = h + doc.astype(np.uint64) * _Q
        o = np.argsort(key, kind="stable")
        out[o[np.r_[True, key[o][1:] != key[o][:-1]]]] = True
    return out


class _Texts:
    """The words of some texts side by side: each word's document, hash and what it is made of."""

    def __init__(self, texts: list[str], powers: _Powers):
        self.many = len(texts)
        c = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32)
        k = _classes()[c]
        edge = np.flatnonzero(np.diff(np.r_[False, k != SPACE, False]))
        a, b = edge[::2], edge[1::2]
        self.doc = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), a, "right")
        self.size = b - a
        self.n = np.bincount(self.doc, minlength=self.many)
        self.hash = powers.parts(c.astype(np.uint64) + np.uint64(1), a, b)

        def among(*kinds: int) -> np.ndarray:
            wanted = np.zeros(SYMBOL + 1, bool)
            wanted[list(kinds)] = True
            return wanted[k]

        def count(*kinds: int) -> np.ndarray:
            sums = np.r_[0, np.cumsum(among(*kinds), dtype=np.int64)]
            return sums[b] - sums[a]

        self.letters, self.upper, self.symbols = count(LOWER, UPPER), count(UPPER), count(SYMBOL)
        self.bare = self.letters + count(DIGIT, WORDLIKE) == 0
        odd = among(SYMBOL, BANG, OPENS)
        self.decorated = odd[b - 1] & odd[b - 2] & (self.size > 1)
        self.exclaims = (k[b - 1] == BANG) & (k[b - 2] == BANG) & (self.size > 1)
        run = (k >= LOWER) & (k <= DIGIT)
        shown = (k != SPACE) & ~(run & np.r_[False, k[1:] == k[:-1]])
        at = np.r_[0, np.cumsum(shown)]
        self.shape = powers.parts(np.where(run, k, c + np.uint32(16))[shown].astype(np.uint64), at[a], at[b])
        self.next = self.doc[1:] == self.doc[:-1]
        self.same = self.next & (self.hash[1:] == self.hash[:-1])
        w = len(self.doc) - 4
        five = np.zeros(max(0, w), np.uint64)
        for i in range(5 if w > 0 else 0):
            five = five * _P + self.hash[i : i + w]
        whole = self.doc[4:] == self.doc[: len(five)]
        self.five_doc, five = self.doc[: len(five)][whole], five[whole]
        self.five_new = _first(self.five_doc, five)

    def per_doc(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[: len(x)], x, self.many)

    def votes(self) -> np.ndarray:
        """Per document: bit k is set if labeller k calls it junk."""
        n = np.maximum(self.n, 1)
        bare = self.per_doc(self.bare)
        pairs = np.maximum(self.n - 1, 1)
        fives = np.maximum(self.n - 4, 1)
        spoken = np.maximum(self.per_doc(self.letters > 1), 1)
        distinct = self.per_doc(_first(self.doc, self.hash))
        new = np.bincount(self.five_doc, self.five_new, self.many)
        fired = (
            self.per_doc(self.decorated) / n >= 0.2,
            self.per_doc(self.symbols) / np.maximum(self.per_doc(self.size), 1) >= 0.08,
            (self.per_doc((self.letters > 1) & (self.upper == self.letters)) / spoken >= 0.5) & (self.n >= 5),
            (self.per_doc(self.exclaims) / n >= 0.2) & (self.n >= 3),
            (bare / n >= 0.1) & (bare >= 2),
            (bare >= 2) & (self.n < 4 * (bare + 1)),
            (self.per_doc(self.same) / pairs >= 0.15) & (self.n >= 6),
            (self.n >= 20) & (distinct < 2 * np.sqrt(n)),
            (self.n >= 20) & (1 - new / fives >= 0.4),
        )
        return sum((f.astype(np.int64) << k for k, f in enumerate(fired)), np.zeros(self.many, np.int64))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (document, bucket, value); values of a kind are shares of its document's words."""
        share = 1 / np.maximum(self.n, 1)
        pair = (self.hash[:-1] * _P + self.hash[1:])[self.next]
        docs = (self.doc, self.doc[:-1][self.next], self.doc, self.doc[:-1][self.same], self.five_doc[~self.five_new])
        fixed = [np.full(len(d), _bucket(np.zeros(1, np.uint64), kind)[0]) for d, kind in zip(docs[3:], (AGAIN, BEFORE), strict=True)]
        j = np.concatenate([_bucket(self.hash, WORD), _bucket(pair, PAIR), _bucket(self.shape, SHAPE), *fixed])
        d = np.concatenate(docs)
        return d, j, share[d]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > TOGETHER:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


_SEEN = pa.schema([("votes", pa.int32()), ("n", pa.int64()), ("h", pa.int64()), ("j", pa.binary()), ("v", pa.binary())])


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, hash, chosen) in; out: how often each vote pattern was seen, and features of chosen documents (each hash once)."""
    powers, counts, had = _Powers(), Counter(), set()
    for b in batches:
        rows = []
        hashes, chosen = b.column(1).to_pylist(), b.column(2).to_pylist()
        for lo, part in _slices(b.column(0).to_pylist()):
            x = _Texts(part, powers)
            votes = x.votes()
            counts.update(votes.tolist())
            wanted = [i for i in range(len(part)) if chosen[lo + i] and x.n[i] <= SAMPLE_WORDS and hashes[lo + i] not in had]
            if wanted:
                d, j, v = x.features()
                for i in wanted:
                    had.add(hashes[lo + i])
                    at, where = np.unique(j[d == i], return_inverse=True)
                    rows.append((int(votes[i]), None, hashes[lo + i], at.astype("<u4").tobytes(), np.bincount(where, v[d == i], len(at)).astype("<f4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SEEN, strict=True)], schema=_SEEN)
    p = list(counts)
    none = [None] * len(p)
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((p, [counts[x] for x in p], none, none, none), _SEEN, strict=True)], schema=_SEEN)


def fit_labellers(counts: dict[int, int], rounds: int = EM_ROUNDS) -> dict:
    """From {vote pattern: rows}: prior of clean, each labeller's rates on clean and junk, each pattern's posterior of clean.

    Starts from labellers that fire on a third of junk and seldom on clean
    documents; this fixes which of the two classes is the clean one.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(p)] for p in patterns], float)
    fired = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    prior, clean, junk = 0.8, np.full(len(LABELLERS), 0.02), np.full(len(LABELLERS), 0.33)
    good = np.zeros(len(n))
    for _ in range(rounds if len(n) else 0):
        a = np.log(prior) + fired @ np.log(clean) + (1 - fired) @ np.log(1 - clean)
        b = np.log(1 - prior) + fired @ np.log(junk) + (1 - fired) @ np.log(1 - junk)
        good = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        w, u = n * good, n * (1 - good)
        prior = float(np.clip(w.sum() / n.sum(), 0.01, 0.99))
        # a labeller is taken to be better than chance: it fires more often on junk
        clean = np.clip((w @ fired + 0.02) / (w.sum() + 1), 1e-4, 0.2)
        junk = np.clip((u @ fired + 0.33) / (u.sum() + 1), np.maximum(0.02, clean), 0.999)
    return {"prior": prior, "clean": dict(zip(LABELLERS, clean, strict=True)), "junk": dict(zip(LABELLERS, junk, strict=True)), "posterior": {int(p): float(g) for p, g in zip(patterns, good, strict=True)}}


def fit_scorer(rows: list[tuple[bytes, bytes]], target: np.ndarray, prior: float, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic scorer on soft targets, by stochastic gradient steps; the same rows give the same weights.

    The last is the bias; it stays at the prior of clean, which is what a text without known features gets.
    """
    w = np.zeros(DIM + 1)
    w[-1] = np.log(prior / (1 - prior))
    x = [(np.frombuffer(j, "<u4"), np.frombuffer(v, "<f4")) for j, v in rows]
    rng = np.random.default_rng(0)
    for k in range(epochs):
        step = 4.0 / (1 + k)
        for i in rng.permutation(len(x)):
            j, v = x[i]
            w[j] += step * (target[i] - 1 / (1 + np.exp(-np.clip(w[j] @ v + w[-1], -30, 30)))) * v
    return w


class Model:
    """What the first pass learns: the labellers' rates and the scorer's weights."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, sample: int):
        arrow.bound(docs.sparkSession)
        n = docs.count()
        h = F.xxhash64(F.col(id_col), F.col(text_col))
        most = int(-(1 << 63) + min(1.0, 0.95 * sample / max(n, 1)) * (2.0**64 - 2048))
        rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), h.alias("h"), (h <= most).alias("chosen"))
        seen = scratch.keep(rows.mapInArrow(_look, "votes int, n long, h long, j binary, v binary"), "votes")
        # at most 2^labellers rows, and at most the sample
        self.labellers = fit_labellers({r.votes: r.n for r in seen.where("n is not null").groupBy("votes").agg(F.sum("n").alias("n")).collect()})
        took = seen.where("n is null").dropDuplicates(["h"]).sort("h").limit(sample).select("votes", "j", "v").toArrow()
        posterior = self.labellers["posterior"]
        target = np.array([posterior[x] for x in took["votes"].to_pylist()])
        self.weights = fit_scorer([(j.as_buffer(), v.as_buffer()) for j, v in zip(took["j"], took["v"], strict=True)], target, self.labellers["prior"])
        scratch.drop(seen)


def _score(texts: list[str], weights: np.ndarray, powers: _Powers) -> np.ndarray:
    """Probability of being clean, a text each."""
    out = np.zeros(len(texts))
    for lo, part in _slices(texts):
        x = _Texts(part, powers)
        d, j, v = x.features()
        out[lo : lo + len(part)] = np.bincount(d, weights[j] * v, len(part)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per input row: id, score (probability of clean), kept.

    Null text is as empty; a text without words is kept or not by the share of
    clean documents alone. Repeated rows count as often as they occur and score
    alike. Null ids are allowed. An empty table gives an empty result; other columns
    are ignored.
    """
    model = Model(docs, id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            score = _score(b.column(1).to_pylist(), shared.value, powers)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(score >= keep)], names=[id_col, "score", "kept"])

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double, kept boolean")


def weak_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, votes (names of the labellers that fired), posterior (of clean); without the scorer."""
    posterior = docs.sparkSession.sparkContext.broadcast(Model(docs, id_col, text_col, 0).labellers["posterior"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            v = [x for _, part in _slices(b.column(1).to_pylist()) for x in _Texts(part, powers).votes().tolist()]
            names = [",".join(x for k, x in enumerate(LABELLERS) if y >> k & 1) for y in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array([posterior.value[x] for x in v], pa.float64())], names=[id_col, "votes", "posterior"])

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, votes string, posterior double")


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; all columns.

    Rows are scored and filtered where they lie, so ids play no part.
    """
    model = Model(docs, id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            score = _score([x or "" for x in b.column(at).to_pylist()], shared.value, powers)
            yield b.filter(pa.array(score >= keep))

    return docs.mapInArrow(run, docs.schema)
