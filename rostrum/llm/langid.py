"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary; a word may be cut into them in
many ways, and its probability in a language is the sum over all cuts of the
product of the language's piece probabilities, which a forward pass gives without
listing them. The probabilities are learned by expectation-maximisation from word
counts of all training texts: counts are summed per language and word before any
piece is looked at, so a word is segmented once however often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.plans import scratch

#: Rounds of expectation-maximisation, from equal probabilities; each reads the table of word counts once.
ROUNDS = 1
#: What is added to a piece's expected count in each language.
SMOOTH = 0.05
#: Letters scored at a time; longer runs are scored stretch by stretch.
STRETCH = 40
#: Distinct chunks that a task counts before it passes counts on, or whose scores it remembers; a long chunk counts as one for each LONG characters.
KEPT, LONG = 200_000, 48
#: Characters of texts whose new chunks are scored together, about; a longer text is scored alone.
TOGETHER = 500_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"


@lru_cache(2)
def pieces(path: str) -> frozenset[str]:
    """The vocabulary's ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))


def words(chunk: str) -> Iterator[str]:
    """The letter runs of a lower-case chunk, marked at their start, in stretches."""
    for run in _LETTERS.findall(chunk):
        run = START + run
        for i in range(0, len(run), STRETCH):
            yield run[i : i + STRETCH]


_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Finds the pieces inside many words at once.

    Substrings are named by a rolling 64-bit hash and looked up in an open-addressed
    table, for all words side by side: one step for each start and length.
    """

    def __init__(self, known):
        self.pieces = sorted(known)
        self.most = max(map(len, self.pieces), default=1)
        #: ids of a character that is no piece, and of no piece at all
        self.other, self.none = len(self.pieces), len(self.pieces) + 1
        bits = max(4, (8 * len(self.pieces)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.none, np.int32)
        for i, p in enumerate(self.pieces):
            h = np.zeros(1, np.uint64)
            for c in p:
                h = h * _BASE + np.uint64(ord(c))
            at = int((h * _SPREAD >> self.shift)[0])
            while self.ids[at] != self.none:
                at = at + 1 & self.mask
            self.keys[at], self.ids[at] = h[0], i

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h * _SPREAD >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], self.none)
        todo = np.flatnonzero((out == self.none) & (self.ids[at] != self.none))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            k = at[todo]
            hit = self.keys[k] == h[todo]
            out[todo[hit]] = self.ids[k[hit]]
            todo = todo[~hit & (self.ids[k] != self.none)]
        return out

    def walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
        """Order of the words by length (longest first), their lengths, and steps (start, end, number of words, ids of the pieces there)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        top = int(size[0]) if len(words) else 0
        chars = np.zeros((len(words), top), np.uint64)
        chars[np.arange(top)[None, :] < size[:, None]] = np.frombuffer("".join(words[k] for k in order).encode("utf-32-le"), np.uint32)
        chars = np.ascontiguousarray(chars.T)
        atleast = np.searchsorted(-size, -np.arange(top + 2), "right")  # how many words have at least so many characters
        steps = []
        for i in range(top):
            h = np.zeros(atleast[i + 1], np.uint64)
            for j in range(i + 1, min(top, i + self.most) + 1):
                n = int(atleast[j])
                h = h[:n] * _BASE + chars[j - 1, :n]
                ids = self.find(h)
                if j == i + 1:
                    ids[ids == self.none] = self.other
                steps.append((i, j, n, ids))
        return order, size, steps


def forward(steps, weights: np.ndarray, n: int, top: int) -> np.ndarray:
    """Sums over all segmentations of the first 0..top characters; weights has a row a piece, and is zero for none."""
    front = np.zeros((top + 1, n, weights.shape[1]))
    front[0] = 1.0
    for i, j, k, ids in steps:
        front[j, :k] += front[i, :k] * weights[ids]
    return front


def expected(lattice: Lattice, words: list[str], times: np.ndarray, weights: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Expected uses of pieces (rows as in weights, the last being none) per column, each word counted so many times in its column."""
    order, size, steps = lattice.walk(words)
    out = np.zeros(weights.shape, float)
    if not len(words):
        return out
    n, top = len(words), int(size[0])
    times, column = times[order], column[order]
    w = [weights[ids, column[:k]] for _, _, k, ids in steps]
    front, back = np.zeros((top + 1, n)), np.zeros((top + 1, n))
    front[0] = 1.0
    back[size, np.arange(n)] = 1.0
    for (i, j, k, _), x in zip(steps, w, strict=True):
        front[j, :k] += front[i, :k] * x
    for (i, j, k, _), x in zip(reversed(steps), reversed(w), strict=True):
        back[i, :k] += back[j, :k] * x
    each = times / np.maximum(front[size, np.arange(n)], 1e-300)
    cells = out.reshape(-1)
    for (i, j, k, ids), x in zip(steps, w, strict=True):
        np.add.at(cells, ids * weights.shape[1] + column[:k], front[i, :k] * x * back[j, :k] * each[:k])
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) in, (lang, chunk, n) out, summed as far as memory allows."""
    held: dict[str, Counter] = {}
    used = 0

    def out() -> pa.RecordBatch:
        rows = [(lang, c, n) for lang, count in held.items() for c, n in count.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "chunk", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            chunks = text.as_py().lower().split()
            held.setdefault(lang, Counter()).update(chunks)
            used += sum(len(c) // LONG for c in chunks if len(c) >= LONG)
            if sum(map(len, held.values())) + used > KEPT:
                yield out()
                held.clear()
                used = 0
    yield out()


def _expect(path: str, langs: list[str], model: np.ndarray | None):
    """(lang, chunk, n) in, (lang, piece's number, expected uses) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        at = {x: k for k, x in enumerate(langs)}
        weights = np.full((lattice.none + 1, len(langs)), 1 / lattice.none) if model is None else model
        weights[lattice.none] = 0
        total = np.zeros(weights.shape)
        for b in batches:
            lang, chunk, n = (b.column(i).to_pylist() for i in range(3))
            found, times, column = [], [], []
            for k in range(len(chunk)):
                for word in words(chunk[k]):
                    found.append(word)
                    times.append(n[k])
                    column.append(at[lang[k]])
            total += expected(lattice, found, np.array(times, float), weights, np.array(column, np.int64))
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([langs[x] for x in k], pa.string()), pa.array(piece, pa.int64()), pa.array(total[piece, k], pa.float64())], names=["lang", "piece", "n"])

    return run


@lru_cache(2)
def _lattice(path: str) -> Lattice:
    return Lattice(pieces(path))


def learn(train: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities: a row a piece, then one for any character outside the vocabulary, then zeros.

    Rows without language or text are left out. The driver gets a row a language; the
    result is languages x vocabulary doubles, 256 KB a language.
    """
    arrow.bound(train.sparkSession)
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = scratch.keep(rows.mapInArrow(_count, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model, size = None, len(pieces(vocabulary))
    for _ in range(rounds if langs else 0):
        seen = np.zeros((size + 2, len(langs)))
        uses = counts.mapInArrow(_expect(vocabulary, langs, model), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        for r in uses.groupBy("lang").agg(F.collect_list("piece").alias("pieces"), F.collect_list("n").alias("n")).toLocalIterator():
            seen[np.array(r.pieces, np.int64), langs.index(r.lang)] = r.n
        model = (seen + SMOOTH) / (seen[:-1].sum(0) + SMOOTH * (size + 1))
        model[size] /= 1000  # shared by all characters outside
        model[size + 1] = 0
    scratch.drop(counts)
    return langs, model if model is not None else np.zeros((size + 2, 0))


#: Bytes of the sums on the way to words' probabilities, and of remembered rows (a double a language); languages that a block of words is cut for.
WORK, ROWS, FEW_LANGUAGES = 32 << 20, 48 << 20, 4


class _Scorer:
    """Log probabilities of chunks in all languages, remembered as rows of a matrix."""

    def __init__(self, lattice: Lattice, model: np.ndarray):
        self.lattice, self.model = lattice, model
        self.rows = np.zeros((1, model.shape[1]))
        self.at: dict[str, int] = {}
        self.used = 0
        self.room = min(KEPT, ROWS // (8 * max(1, model.shape[1])))

    def words(self, found: list[str]) -> np.ndarray:
        """A block of words and languages at a time, so that the sums on the way take WORK bytes or one word's in one language."""
        out = np.zeros((len(found), self.model.shape[1]))
        by = sorted(range(len(found)), key=lambda k: len(found[k]))
        at = 0
        while at < len(by):
            to = at + 1
            while to < len(by) and (to + 1 - at) * (len(found[by[to]]) + 1) * 8 * FEW_LANGUAGES <= WORK:
                to += 1
            part = np.array(by[at:to])
            order, size, steps = self.lattice.walk([found[k] for k in part])
            top, many = int(size[0]), max(1, WORK // (8 * (int(size[0]) + 1) * len(part)))
            for k in range(0, out.shape[1], many):
                front = forward(steps, self.model[:, k : k + many], len(part), top)
                out[part[order], k : k + many] = np.log(np.maximum(front[size, np.arange(len(part))], 1e-300))
            at = to
        return out

    def learn(self, chunks: set[str]) -> None:
        """Score the chunks that aren't known yet; row 0 is for those without letters."""
        at = self.at
        new = [c for c in chunks if c not in at]
        if self.used + len(new) > self.room:
            at.clear()
            self.rows, new, self.used = self.rows[:1].copy(), list(chunks), 0
        self.used += sum(1 + len(c) // LONG for c in new)
        found: dict[str, int] = {}
        chunk, word, n = [], [], len(self.rows)
        for c in new:
            inside = list(words(c))
            at[c] = n if inside else 0
            for w in inside:
                chunk.append(n - len(self.rows))
                word.append(found.setdefault(w, len(found)))
            n += bool(inside)
        if found:
            more = np.zeros((n - len(self.rows), self.model.shape[1]))
            np.add.at(more, chunk, self.words(list(found))[word])
            self._append(more)

    def _append(self, more: np.ndarray) -> None:
        n = len(self.rows)
        base = self.rows.base if self.rows.base is not None else self.rows
        if n + len(more) > len(base):
            base = np.zeros((max(n + len(more), min(2 * (n + len(more)), self.room)), more.shape[1]))
            base[:n] = self.rows
        base[n : n + len(more)] = more
        self.rows = base[: n + len(more)]


def _together(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (posterior under equal priors).

    `und` with score 0 where the text is null or has no letter, or nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        scorer = _Scorer(_lattice(vocabulary), table)
        for b in batches:
            langs, scores = [], []
            for part in _together(b.column(1).to_pylist()):
                texts = [t.lower().split() for t in part]
                if known:
                    scorer.learn(set().union(*texts))
                for t in texts:
                    rows = np.fromiter(map(scorer.at.__getitem__, t), np.int64, len(t)) if known else np.zeros(0, np.int64)
                    if not rows.any():
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    s = scorer.rows[rows].sum(0)
                    k = int(s.argmax())
                    langs.append(known[k])
                    scores.append(float(1 / np.exp(s - s[k]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, mod 3, is 1; a null id is as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows that aren't held out, predict all: id, held_out, lang_pred, score.

    Only the text is looked at for a prediction. Repeated rows count as often as
    they occur; an empty table gives an empty result.
    """
    model = learn(docs.where(~held_out(id_col)), vocabulary, lang_col, text_col, rounds)
    return predict(docs, model, vocabulary, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
