"""EM on simulated labellers, and the classifier on documents of known kinds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from rostrum.llm import quality

SCHEMA = "doc_id long, text string, score string"


def test_em_recovers_rates():
    rng = np.random.default_rng(0)
    junk_rate = np.array([0.5, 0.4, 0.3, 0.5, 0.3, 0.2, 0.6, 0.3, 0.4])
    n = 60_000
    bad = rng.random(n) < 0.2
    fired = rng.random((n, 9)) < np.where(bad[:, None], junk_rate, 0.01)
    m = quality.fit_labellers(Counter((fired << np.arange(9)).sum(1).tolist()))
    assert abs(m["prior"] - 0.8) < 0.02
    assert np.allclose([m["junk"][x] for x in quality.LABELLERS], junk_rate, atol=0.04)
    assert np.allclose([m["clean"][x] for x in quality.LABELLERS], 0.01, atol=0.01)


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(3, 300))]
        w[0] = w[0].capitalize()
        kind = rng.choice(["clean"] * 6 + ["symbols", "caps", "pipes", "stutter"])
        if kind == "symbols":
            w = [x + rng.choice(["***", "$$$", "%%%", "&&&"]) for x in w]
        if kind == "caps":
            w = [x.upper() + "!!" for x in w] * 2
        if kind == "pipes":
            w = " | ".join(w).split()
        if kind == "stutter":
            w = [x for x in w[:12] for _ in range(15)]
        out.append((i, " ".join(w) + ".", kind))
    return out


def test_rejects_junk_and_keeps_clean_and_odd_rows(spark):
    rows = texts(random.Random(1), 500)
    odd = [(900, None, ""), (901, "", ""), (902, "One.", ""), (903, "a plain word " * 20_000, ""), (None, "no id but a clean text", ""), (0, rows[0][1], "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    got = quality.classify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    wrong = [i for i, _, k in rows if by[i].kept != (k == "clean")]
    assert len(wrong) <= 5 and not [i for i in wrong if rows[i][2] == "clean"]
    assert all(by[i].kept for i in (900, 901, 902, None))
    kept = quality.keep_clean(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted((tuple(r) for r in rows + odd if by[r[0]].kept), key=repr)


def test_empty_table_and_reruns(spark):
    assert quality.classify(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(texts(random.Random(2), 60), SCHEMA)
    a, b = (sorted(map(tuple, quality.classify(d).collect())) for d in (df, df.repartition(5)))
    assert [(r[0], r[2]) for r in a] == [(r[0], r[2]) for r in b]


def test_the_query_equals_plain_loops(spark):
    """Votes, EM and the scorer's features by plain loops over words; the trained scores agree with the weak labels on rows outside the sample."""
    import re
    import unicodedata

    rows = texts(random.Random(3), 700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def plain(text):
        w = text.split()
        n = len(w)
        symbol = lambda c: not (unicodedata.category(c)[0] in "LMN" or c.isspace() or c in "_.,;:?!()\"'«»“”‘’…-]")
        odd = lambda c: symbol(c) or c in "!(«“‘"
        letters = [sum(unicodedata.category(c)[0] in "LM" for c in x) for x in w]
        spoken = [x for x, k in zip(w, letters, strict=True) if k > 1]
        bare = sum(not any(c.isalnum() for c in x) for x in w)
        fives = [tuple(w[i : i + 5]) for i in range(n - 4)]
        return (
            sum(len(x) > 1 and odd(x[-1]) and odd(x[-2]) for x in w) >= 0.2 * max(n, 1),
            sum(map(symbol, "".join(w))) >= 0.08 * max(1, len("".join(w))),
            n >= 5 and sum(all(c.isupper() for c in x if c.isalpha()) for x in spoken) >= 0.5 * max(1, len(spoken)),
            n >= 3 and sum(x.endswith("!!") for x in w) >= 0.2 * n,
            bare >= 2 and bare >= 0.1 * n,
            bare >= 2 and n < 4 * (bare + 1),
            n >= 6 and sum(a == b for a, b in zip(w, w[1:], strict=False)) >= 0.15 * (n - 1),
            n >= 20 and len(set(w)) < 2 * n**0.5,
            n >= 20 and 1 - len(set(fives)) / len(fives) >= 0.4,
        )

    fired = np.array([plain(t) for _, t, _ in rows])
    prior, good = 0.8, np.zeros(len(rows))
    clean, junk = [0.02] * 9, [0.33] * 9
    for _ in range(quality.EM_ROUNDS):
        for i, f in enumerate(fired):
            a, b = prior, 1 - prior
            for k in range(9):
                a *= clean[k] if f[k] else 1 - clean[k]
                b *= junk[k] if f[k] else 1 - junk[k]
            good[i] = a / (a + b)
        prior = min(0.99, max(0.01, good.mean()))
        for k in range(9):
            clean[k] = min(0.2, max(1e-4, (sum(good[fired[:, k]]) + 0.02) / (good.sum() + 1)))
            junk[k] = min(0.999, max(0.02, clean[k], (sum(1 - good[fired[:, k]]) + 0.33) / ((1 - good).sum() + 1)))
    weak = {r.doc_id: r for r in quality.weak_labels(df).collect()}
    for i, (d, *_) in enumerate(rows):
        assert weak[d].votes == ",".join(x for x, f in zip(quality.LABELLERS, fired[i], strict=True) if f)
        assert abs(weak[d].posterior - good[i]) < 1e-6
    got = {r.doc_id: r.kept for r in quality.classify(df, sample=300).collect()}
    assert np.mean([got[d] == (weak[d].posterior >= 0.5) for d, *_ in rows]) > 0.98  # more than half of them outside the sample

    x = quality._Texts(["Ab ab ab c1! ÉÀ-x 12"], quality._Powers())
    d, j, v = x.features()
    assert len(j) == 6 + 5 + 6 + 1 and abs(v - 1 / 6).max() < 1e-9 and not d.any()
    assert len(set(j[:6])) == 5 and len(set(j[6:11])) == 5
    run = lambda w: re.sub(r"(a)a+|(A)A+|(0)0+", r"\1\2\3", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
    forms = [run(w) for w in "Ab ab ab c1! ÉÀ-x 12".split()]
    assert [forms[a] == forms[b] for a in range(6) for b in range(6)] == [j[11 + a] == j[11 + b] for a in range(6) for b in range(6)]
