"""Queries without SQL over the given tables, against the plain versions of their tests."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rostrum.llm import entries, html_extract
from tests.llm import test_alignment as plain_alignment
from tests.llm import test_runs as plain_runs
from tests.llm import test_substring_dedup as plain_dedup

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no tables")


def docs():
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def rows(df):
    return sorted(repr(tuple(x)) for x in df.collect())


def test_periodic_runs(spark, monkeypatch):
    def plain(words):
        numbers: dict = {}
        w = np.array([numbers.setdefault(x, len(numbers)) for x in words])
        seen: dict = {}
        for p in range(1, len(w) // 2 + 1):
            edge = np.flatnonzero(np.diff(np.r_[False, w[p:] == w[:-p], False].astype(np.int8)))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if j - i >= p:
                    seen.setdefault((i, j + p), p)
        return sorted((s, e, p) for (s, e), p in seen.items() if e - s >= max(12, 2 * p))

    monkeypatch.setattr(plain_runs, "plain", plain)
    got = entries.op11_periodic_runs(spark, SMALL)
    assert rows(got) == sorted(repr(plain_runs.row(*d)) for d in docs())
    assert got.where("n_runs > 0").count() > 15


def test_substring_dedup(spark):
    got = entries.op12_substring_dedup(spark, SMALL)
    assert rows(got) == plain_dedup.plain(docs())
    assert got.where("n_removed > 0").count() > 15


def test_token_alignment(spark):
    a = Tokenizer.from_file(plain_alignment.A)
    a.encode_special_tokens = True
    assert rows(entries.op13_token_alignment(spark, SMALL)) == plain_alignment.plain(docs(), (a, SentencePieceProcessor(model_file=plain_alignment.B)))


def test_pages_keep_their_text_when_no_tag_says_article(spark):
    """The deduced slot in place of the tag: article elements renamed, on hosts of ten pages or more."""
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet").select("page_id", "url", "html")
    renamed = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(article|main)\\b", "<div"), "</(article|main)\\s*>", "</div>"))
    host = {x.page_id: x.url.split("/")[2] for x in pages.select("page_id", "url").collect()}
    many = {h for h, n in Counter(host.values()).items() if n >= 10}
    want = {x.page_id: x.text for x in html_extract.extract(pages).collect()}
    got = {x.page_id: x.text for x in html_extract.extract(renamed).collect()}
    judged = [i for i in want if host[i] in many]
    assert len(judged) > 50 and sum(got[i] == want[i] for i in judged) >= 0.98 * len(judged)
