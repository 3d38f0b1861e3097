"""The pipeline's stages against plain versions on a small corpus."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rostrum.llm import exact_dedup, jaccard_join, mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(8, 120))]
        if i % 10 == 0:
            w = [x + "***" for x in w]
        rows.append([i, " ".join(w)])
    rows += [[200 + i, rows[i][1] + " "] for i in range(1, 20)]  # copies that win by length
    rows += [[300 + i, rows[i][1].rsplit(" ", 1)[0]] for i in range(21, 40)]  # near copies
    return [(d, t, "en", f"s{d % 3}", len(t)) for d, t in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = docs.collect()
    kept = {r.doc_id for r in quality.classify(spark.createDataFrame(rows, SCHEMA)).collect() if r.kept}
    assert {r.doc_id for r in seen["quality"]} == kept and {d for d, t, *_ in rows if "***" not in t} == kept
    strip = lambda t: re.sub(r"\s", "", t)
    best = {}
    for r in seen["quality"]:
        k = strip(r.text)
        best[k] = min(best.get(k, (0, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in seen["exact_dedup"]) == sorted(d for _, d in best.values())
    grams = {r.doc_id: {tuple(r.text.split()[i : i + 5]) for i in range(len(r.text.split()) - 4)} or {tuple(r.text.split())} for r in seen["exact_dedup"]}
    root = {d: d for d in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted({r for r in root.values()})
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(seen["near_dedup"], SCHEMA)).collect() if r.copies}
    assert Counter(r.doc_id for r in seen["mixing"]) == want
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in seen["bpe"]) == Counter((r.doc_id, sha(r.text)) for r in seen["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["bpe"])


def test_clean_rows_stay_beside_others_of_their_id(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9)))
    w = lambda n: " ".join(word() for _ in range(n))
    bad = lambda: " ".join(x + "***" for x in w(80).split())
    clean = [(None, w(80)), (7, w(80))] + [(100 + i, w(80)) for i in range(40)]
    rows = clean + [(None, bad()), (7, bad())] + [(200 + i, bad()) for i in range(8)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(3)
    got = quality.keep_clean(df)
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(clean, key=repr)


def test_near_copies_go_by_row(spark):
    rng = random.Random(7)
    w = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    text, other, third = w(80), w(80), w(80)
    rows = [(1, text), (5, text + " end"), (5, w(80)), (None, w(80)), (None, other), (None, other + " end"), (9, third), (9, third), (8, ""), (8, None), (None, " ")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect())
    pair = [(None, other), (None, other + " end")]
    assert sum(got[x] for x in pair) == 1  # of two rows without id one stays
    assert got - Counter(pair) == Counter([rows[0], rows[2], rows[3], (9, third), *rows[8:]])


NAMES = ["_n", "_digest", "shard", "_gone", "row_key", "CUT", "copy_number", "size", "key", "h"]


def odd_rows():
    """Null and repeated ids, repeated rows, copies and odd texts, under names that clash with those inside the operators."""
    rng = random.Random(8)
    w = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    texts = [w(rng.randrange(1, 60)) for _ in range(30)]
    rows = [(rng.choice([None, *range(25)]), rng.choice([t, t, t.replace(" ", "  "), t + " ", t + " end"]), f"s{k % 3}") for k, t in enumerate(texts * 3)]
    return rows + [(3, None, None), (3, "", "s0"), (None, None, "s1"), (4, "x" * 50_000, "s1"), (4, "long " * 30_000, "s2"), rows[0], rows[0]]


def test_stages_with_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    rows = odd_rows()
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in NAMES)
    df = spark.createDataFrame([(*r, *[f"{c}{k % 4}" for c in NAMES]) for k, r in enumerate(rows)], schema).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
        empty = stage(spark, spark.createDataFrame([], schema), "")
        assert empty.columns == df.columns and empty.count() == 0
    strip = lambda t: re.sub(r"[ \t-\r]", "", t or "")
    best = {}
    for d, t, _ in rows:
        k = strip(t)
        best[k] = min(best.get(k, (0, True, 1 << 60)), (-len(t or ""), d is None, d or 0))
    got = {}
    for r in exact_dedup.drop_copies(df).collect():
        assert strip(r.text) not in got
        got[strip(r.text)] = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
    assert got == best
    key = lambda d, t, s: (d, t or "", s)
    want = Counter()
    for r in mixing.mix(df.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("n"))).collect():
        want[r.doc_id, r["size"], r.source] += r.copies
    took = Counter((r.doc_id, len((r.text or "").split()), r.source) for r in mixing.take(df).collect())
    assert took == +want
    sharding.write(df, str(tmp_path / "out"), limit_bytes=4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(key(*r[:3]) for r in back.select("doc_id", "text", "source").collect()) == Counter(key(*r) for r in rows)
    assert set(back.columns) - set(df.columns) == {"shard_"} and back.where("shard is null").count() == 0
    assert len(corpus_pipeline.STAGES[-1][1](spark, df, "").collect()) == len(rows)
