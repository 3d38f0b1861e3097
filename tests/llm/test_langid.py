"""Segment sums, learned probabilities and scores against listing every segmentation, and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from rostrum.llm import langid

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score string"


def cuts(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        for rest in cuts(word[k:]):
            yield (word[:k], *rest)


def test_sums_over_all_segmentations():
    known = {"▁", "▁a", "a", "b", "ab", "ba", "abb", "▁ab"}
    lattice = langid.Lattice(known)
    rng = np.random.default_rng(0)
    model = rng.random((len(known) + 2, 2))
    model[lattice.none] = 0
    at = {p: i for i, p in enumerate(lattice.pieces)}
    rows = lambda c: [at.get(p, lattice.other) for p in c]
    found = ["▁abba", "▁ababbab", "▁aéb", "b"]
    got = langid._Scorer(lattice, model).words(found)
    times, column = np.array([3.0, 1.0, 2.0, 1.0]), np.array([0, 1, 0, 1])
    want = np.zeros(model.shape)
    for w, row, n, x in zip(found, got, times, column, strict=True):
        legal = [c for c in cuts(w) if all(p in known or len(p) == 1 for p in c)]
        total = sum(np.prod(model[rows(c)], 0) for c in legal)
        assert np.allclose(row, np.log(total))
        for c in legal:
            for r in rows(c):
                want[r, x] += n * np.prod(model[rows(c)], 0)[x] / total[x]
    assert np.allclose(langid.expected(lattice, found, times, model, column), want)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    words = {"en": "the of and talk speaker slide with this people".split(), "fr": "le de et parole école avec cette gens être".split(), "de": "der von und rede schüler mit dieser leute".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 30))).capitalize() + ".", lang, "clash"))
    odd = [(1000, None, "en", ""), (1001, "123 -- !!", "en", ""), (1002, "", None, ""), (1003, "x" * 5000, None, ""), (1004, "漢字", None, ""), (None, "the talk", "en", ""), (rows[0][0], rows[0][1], rows[0][2], "")]
    got = langid.identify(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), VOCABULARY).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred in words and by[1004].lang_pred in words and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def plain(rows, rounds):
    """The whole query by loops over all segmentations: {doc_id: (lang_pred, score)}."""
    known = langid.pieces(VOCABULARY)
    runs = lambda t: ["▁" + r for r in re.findall(r"[^\W\d_]+", (t or "").lower())]
    legal = {w: [c for c in cuts(w) if all(p in known or len(p) == 1 for p in c)] for _, t, *_ in rows for w in runs(t)}
    name = lambda p: p if p in known else None
    train = [(lang, w) for d, t, lang, _ in rows if lang and zlib.crc32(str(d).encode()) % 3 != 1 for w in runs(t)]
    langs, size = sorted({lang for lang, _ in train}), len(known)
    prob = {lang: defaultdict(lambda: 1 / (size + 1)) for lang in langs}
    chance = lambda lang, c: math.prod(prob[lang][name(p)] for p in c)
    for _ in range(rounds):
        seen = {lang: Counter() for lang in langs}
        for lang, w in train:
            total = sum(chance(lang, c) for c in legal[w])
            for c in legal[w]:
                for p in c:
                    seen[lang][name(p)] += chance(lang, c) / total
        prob = {}
        for lang in langs:
            all_ = seen[lang].total() + langid.SMOOTH * (size + 1)
            prob[lang] = defaultdict(lambda all_=all_: langid.SMOOTH / all_, {p: (n + langid.SMOOTH) / all_ for p, n in seen[lang].items()})
            prob[lang][None] /= 1000
    out = {}
    for d, t, *_ in rows:
        logs = {lang: sum(math.log(sum(chance(lang, c) for c in legal[w])) for w in runs(t)) for lang in langs}
        best = max(logs, key=logs.get)
        out[d] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())) if runs(t) else ("und", 0.0)
    return out


@pytest.mark.parametrize("rounds", [langid.ROUNDS, 2])
def test_query_against_plain_loops(spark, rounds):
    rng = random.Random(2)
    words = ["the", "theme", "seven", "le", "leçon", "Été", "der", "Leute", "dört", "ꙮa", "x9y", "--", "A.b"]
    rows = [(i, " ".join(rng.choice(words[k : k + 7]) for _ in range(rng.randrange(1, 5))), ["en", "fr", "de"][k % 3], "") for i, k in enumerate(rng.choices(range(7), k=60))]
    rows += [(100, None, "en", ""), (101, "le dört", None, ""), (102, "9 --", "fr", "")]
    want = plain(rows, rounds)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA).repartition(3), VOCABULARY, rounds=rounds).collect()}
    assert got.keys() == want.keys()
    for d, (lang, score) in want.items():
        assert math.isclose(got[d].score, score, rel_tol=1e-9), d
        assert got[d].lang_pred == lang or math.isclose(score, 1 / 2) or math.isclose(score, 1 / 3), d


def test_nothing_to_learn_from(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "some words", None, "")], SCHEMA), VOCABULARY).first().lang_pred == "und"


def test_blocks_of_words_and_languages_change_nothing(monkeypatch):
    """A hundred languages in small blocks give the same probabilities; the sums on the way stay small."""
    lattice = langid._lattice(VOCABULARY)
    rng = np.random.default_rng(4)
    model = rng.random((lattice.none + 1, 100)) / 1000
    model[lattice.none] = 0
    found = ["a", "hello", "internationalisation", "zz", "straße", "x" * 40, "naïve"] + ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 12))) for _ in range(300)]
    whole = langid._Scorer(lattice, model).words(found)
    seen = []
    plain = langid.forward
    monkeypatch.setattr(langid, "forward", lambda steps, w, n, top: seen.append((top + 1) * n * w.shape[1] * 8) or plain(steps, w, n, top))
    monkeypatch.setattr(langid, "WORK", 20_000)
    assert np.array_equal(langid._Scorer(lattice, model).words(found), whole)
    assert max(seen) <= 20_000 and len(seen) > 50


def test_remembered_rows_are_bounded_in_bytes(monkeypatch):
    lattice = langid._lattice(VOCABULARY)
    model = np.full((lattice.none + 1, 100), 1e-4)
    model[lattice.none] = 0
    monkeypatch.setattr(langid, "ROWS", 100 * 8 * 50)
    scorer = langid._Scorer(lattice, model)
    for k in range(40):
        scorer.learn({f"word{chr(97 + k % 26)}{chr(97 + j)}" for j in range(20)} | {"same"})
        base = scorer.rows.base if scorer.rows.base is not None else scorer.rows
        assert base.nbytes <= 100 * 8 * 72 and "same" in scorer.at
