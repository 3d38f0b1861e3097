"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of words with smallest period p and at least 2 p words.
All texts of a block lie one after the other in one array of word numbers, apart by
numbers of their own, so no run crosses from one to the next.

* Highly periodic regions: periods below SMALL are found by holding the array
  against itself at each of these distances.
* Scales t = 4, 8, 16, ...: place i belongs to the synchronising set if, of the names
  (hashes) of the t-word strings at i..i+t, those of period t/3 or less left aside,
  the least is the first or the last. Whether i belongs is told by its context, the
  2 t words from i. Two members at a distance of 3 t to 6 t with equal contexts
  propose their distance as a period. Equal contexts lie more than t/3 apart, so a
  member has at most 18 such partners.
* Every run of period p in [3 t, 6 t) is proposed, unless its first length - p words
  have themselves a period q of t/3 or less: every t places hold a member except where
  3 t - 1 words have such a period. That run then lies across two neighbouring
  runs of period q, found at a smaller scale, that overlap by less than q words; all
  periods that put one's phase on the other are proposed.
* A proposal is extended both ways by binary search on prefix hashes. Of
  equal stretches the smallest period stays.

The work is a few array passes over the texts that are long enough for a scale (6 t
words), and the memory some hundred bytes a word of a block or of the longest text.
Words are told apart exactly; strings of words by polynomial hashes modulo two primes
near 2^31, so two different strings pass as equal with a chance of about 10^-18.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow

#: A run has this many words at least, and two periods.
LEAST = 12
#: Periods below this are found directly; it is three times the smallest scale.
SMALL = 12
#: Words that are searched side by side; a longer text is searched alone.
BLOCK = 1 << 19

_PRIMES = ((2147483647, 1103515247), (2147483629, 1812433253))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Prefix:
    """Names of substrings: prefix sums of words times powers, modulo two primes."""

    def __init__(self, w: np.ndarray):
        n = len(w)
        seeds = _mix(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.sums, self.powers = [], []
        for k, (p, base) in enumerate(_PRIMES):
            power = np.ones(n + 1, np.uint64)
            size, top = 1, base
            while size <= n:  # power[i] = base^i by doubling
                m = min(size, n + 1 - size)
                power[size : size + m] = power[:m] * np.uint64(top) % np.uint64(p)
                size, top = size * 2, top * top % p
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((seeds >> np.uint64(1 + 31 * k) & np.uint64(0x7FFFFFFF)) % np.uint64(p) * power[:n] % np.uint64(p), out=total[1:])
            self.sums.append(total % np.uint64(p))
            self.powers.append(power)

    def names(self, size: int) -> np.ndarray:
        """A name for the substring of `size` words at each place."""
        out = None
        n = len(self.sums[0]) - 1
        for (p, _), s, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            x = (s[size:] + np.uint64(p) - s[: n - size + 1]) % np.uint64(p) * power[n - size :: -1][: n - size + 1] % np.uint64(p)
            out = x if out is None else out << np.uint64(31) | x
        return out

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the substrings of `size` words at i < j are equal."""
        ok = np.ones(len(i), bool)
        for (p, _), s, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(p)
            ok &= (s[i + size] + p - s[i]) % p * power[j - i] % p == (s[j + size] + p - s[j]) % p
        return ok

    def stretch(self, i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch around i, i + d in which words d apart are equal: its start and its end."""
        n = len(self.sums[0]) - 1
        step = 1 << max(0, n.bit_length() - 1)
        fore, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        while step:
            go = np.flatnonzero(i + d + fore + step <= n)
            go = go[self.same(i[go] + fore[go], i[go] + d[go] + fore[go], np.full(len(go), step))]
            fore[go] += step
            go = np.flatnonzero(back + step <= i)
            go = go[self.same(i[go] - back[go] - step, i[go] + d[go] - back[go] - step, np.full(len(go), step))]
            back[go] += step
            step >>= 1
        return i - back, i + d + fore


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _direct(w: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least 2 p words in which words p apart are equal."""
    same = np.zeros(len(w) - p + 2, np.int8)
    same[1:-1] = w[p:] == w[:-p]
    edge = np.flatnonzero(np.diff(same))
    s, e = edge[::2], edge[1::2] + p
    ok = e - s >= 2 * p
    return s[ok], e[ok]


def _unique(s: np.ndarray, e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period."""
    o = np.lexsort((p, e, s))
    s, e, p = s[o], e[o], p[o]
    new = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(s) else np.zeros(0, bool)
    return s[new], e[new], p[new]


def _members(names: np.ndarray, w_len: int, t: int, known: tuple[np.ndarray, ...]) -> np.ndarray:
    """The synchronising set of scale t; names are those of t words, known all runs of period t/3 or less."""
    s, e, p = known
    inside = (3 * p <= t) & (e - s >= t)
    edge = np.zeros(w_len + 1, np.int32)
    np.add.at(edge, s[inside], 1)
    np.add.at(edge, e[inside] - t + 1, -1)
    aside = np.cumsum(edge)[: len(names)] > 0
    x = _mix(names) >> np.uint64(1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    x[aside] = none
    least = _least(x, t + 1)
    return np.flatnonzero((least != none) & ((x[: len(least)] == least) | (x[t:] == least)))


def _across(t: int, known: tuple[np.ndarray, ...], prefix: _Prefix) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods, within scale t, of runs that lie across two neighbouring runs of one smaller period."""
    s, e, q = known
    long = (3 * q <= t) & (e - s >= 9 * q)
    s, e, q = s[long], e[long], q[long]
    o = np.lexsort((s, q))
    s, e, q = s[o], e[o], q[o]
    at = np.flatnonzero((q[1:] == q[:-1]) & (s[1:] <= e[:-1]) & (e[1:] - s[:-1] >= 6 * t))
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, c, d, r in zip(s[at].tolist(), e[at].tolist(), s[at + 1].tolist(), e[at + 1].tolist(), q[at].tolist(), strict=True):
        turn = np.flatnonzero(prefix.same(a + np.arange(r), np.full(r, c), np.full(r, r)))
        if len(turn):
            # the second run begins as the first does turn words from its start, so words p apart are alike for p = c - a - turn modulo r
            p = np.arange(3 * t + (c - a - int(turn[0]) - 3 * t) % r, min(6 * t, (d - a) // 2 + 1), r)
            lo, hi = np.maximum(a, c - p), np.minimum(b, d - p)
            fit = hi - lo >= p
            places.append(lo[fit])
            periods.append(p[fit])
    return np.concatenate(places), np.concatenate(periods)


def find(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least LEAST words: starts, ends and smallest periods, by start, then period.

    w holds the word numbers of several texts, one after the other, sizes their lengths.
    """
    gap = np.int64(w.max() + 1 if len(w) else 0)
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    runs = (np.zeros(0, np.int64),) * 3
    t = 0
    while True:
        keep = sizes >= (LEAST if not t else 6 * t)  # texts that can hold a run of this scale
        if not keep.any():
            break
        # each of them, with a number of its own after it
        size = sizes[keep] + 1
        begin = np.cumsum(size) - size
        at = np.repeat(starts[keep] - begin, size) + np.arange(size.sum())
        ends = begin + size - 1
        at[ends] = 0
        x = w[at]
        x[ends] = gap + np.arange(len(ends))
        to = np.repeat(starts[keep] - begin, size)  # from a place here to a place in w
        if not t:
            found = []
            for p in range(1, min(SMALL, len(x))):
                s, e = _direct(x, p)
                found.append((s + to[s], e + to[s], np.full(len(s), p, np.int64)))
            runs = _unique(*map(np.concatenate, zip(*found, strict=True)))
            t = SMALL // 3
        else:
            # runs known so far, as places here
            owner = np.searchsorted(starts[keep], runs[0], "right") - 1
            inside = (owner >= 0) & (runs[0] < starts[keep][owner] + sizes[keep][owner]) if len(runs[0]) else np.zeros(0, bool)
            shift = (begin - starts[keep])[owner[inside]]
            known = runs[0][inside] + shift, runs[1][inside] + shift, runs[2][inside]
            prefix = _Prefix(x)
            i = _members(prefix.names(t), len(x), t, known)
            name = prefix.names(2 * t)[i]
            o = np.argsort(name, kind="stable")
            i, name = i[o], name[o]
            place, period = _across(t, known, prefix)
            places, periods = [place], [period]
            for k in range(1, min(19, len(i))):
                d = i[k:] - i[:-k]
                near = (name[k:] == name[:-k]) & (d < 6 * t)
                if not near.any():
                    break
                near &= d >= 3 * t
                places.append(i[:-k][near])
                periods.append(d[near])
            place, period = np.concatenate(places), np.concatenate(periods)
            s, e = prefix.stretch(place, period)
            ok = e - s >= 2 * period
            s, e, period = _unique(s[ok], e[ok], period[ok])
            runs = _unique(*map(np.concatenate, zip(runs, (s + to[s], e + to[s], period), strict=True)))
            t *= 2
    s, e, p = runs
    ok = e - s >= LEAST
    s, e, p = s[ok], e[ok], p[ok]
    o = np.lexsort((p, s))
    return s[o], e[o], p[o]


def _repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, periodic from some place on in one of ten documents, as their ids say; a null id never."""
    n = len(words)
    if not n or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    times = -(-(n - a) // p)
    return words[:a] + (tail * times)[: n - a]


_NONE = hashlib.sha256(b"").hexdigest()
_OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(ids: list[int | None], texts: list[list[bytes]]) -> list[tuple]:
    """Of each text of a block: the columns of _OUT."""
    number = defaultdict(count().__next__)
    sizes = np.array(list(map(len, texts)), np.int64)
    w = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    s, e, p = find(w, sizes)
    begin = np.cumsum(sizes) - sizes
    # words after a run's first period go
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, s + p, 1)
    np.add.at(edge, e, -1)
    stays = np.cumsum(edge)[:-1] == 0
    owner = np.searchsorted(begin, s, "right") - 1
    # an empty text begins where the next one does; the last with that beginning holds the run
    first = np.searchsorted(owner, np.arange(len(texts)), "left")
    last = np.searchsorted(owner, np.arange(len(texts)), "right")
    out = []
    for k, words in enumerate(texts):
        b, n = int(begin[k]), len(words)
        i, j = int(first[k]), int(last[k])
        if i == j:
            out.append((0, None, None, None, None, _NONE, hashlib.sha256(b" ".join(words)).hexdigest()))
            continue
        start, length, period = s[i:j] - b, e[i:j] - s[i:j], p[i:j]
        best = int(np.lexsort((period, start, -length))[0])
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        kept = b" ".join(compress(words, stays[b : b + n].tolist()))
        out.append((j - i, int(start[best]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best]), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row per input row: id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Null and empty texts have no words and no run; without a run the longest run's
    columns are null, and the digests are those of no run and of the words as they
    are. Repeated rows give equal rows; other columns are ignored; an empty table gives
    an empty result. With planted, the texts of one in ten integer ids end
    periodically, as said at _repeated.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            cols = list(zip(*_rows(ids, texts), strict=True))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[id_col, *[c.split()[0] for c in _OUT.split(", ")]])

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = t.as_py().split()
                if planted:
                    words = _repeated(words, i)
                if ids and size + len(words) > BLOCK:
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
        if ids:
            yield block()

    arrow.bound(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {_OUT}")
