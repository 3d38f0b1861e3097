"""Token links against the libraries and plain loops over all tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rostrum.llm import alignment
from rostrum.llm.bpe import byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(docs, libraries):
    """What the contract says, document by document."""
    a, b = libraries
    to_byte = byte_of_char()
    rows, holds = [], Counter()
    for i, text in docs:
        groups = []
        if text:
            x = a.encode(" " + text, add_special_tokens=False)
            y = b.encode(text)
            xb = [bytes(map(to_byte.__getitem__, t)) for t in x.tokens]
            yb = []
            for t in y:
                p = b.id_to_piece(t)
                yb.append(bytes([int(p[3:5], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode())
            raw = (" " + text).encode()
            if b"".join(xb) == raw == b"".join(yb):
                xe, ye = np.cumsum(list(map(len, xb))).tolist(), np.cumsum(list(map(len, yb))).tolist()
                i0 = j0 = 0
                for cut in sorted(set(xe) & set(ye)):
                    i1, j1 = xe.index(cut, i0) + 1, ye.index(cut, j0) + 1
                    groups.append((x.ids[i0:i1], y[j0:j1]))
                    i0, j0 = i1, j1
        links = Counter((u, v) for g, h in groups for u in g for v in h)
        holds.update(links.keys())
        rows.append((i, groups, links))
    top = {}
    for (u, _), n in holds.items():
        top[u] = max(top.get(u, 0), n)
    out = []
    for i, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append(
            (
                i,
                sum(len(g) for g, _ in groups),
                sum(len(h) for _, h in groups),
                len(groups),
                sum(links.values()),
                sum(n for k, n in links.items() if holds[k] == top[k[0]]),
                sum(n * holds[k] for k, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(map(repr, out))


def texts():
    r = random.Random(4)
    words = "the cat <s> </s> <|endoftext|> déjà über naïve 東京 大阪 привет мир مرحبا हिन्दी 😀 👩‍👩‍👧 it's 3.14159 2024-01-02 foo_bar x=y+z ---- ==== ........ ́ ﬁ ½ ' \" <0x41> unbelievability".split(" ")
    spaces = [" ", " ", " ", "  ", "\n", "\t", " \n ", "\r\n", " ", "　", "\x1c", " ", "\x85", ""]
    out = [None, "", " ", "   ", "\n", "a", " a", "a ", "▁", "a ▁b", "x▁", "\x00", "\x00 a\x00", "é" * 50, " " * 300, "=" * 1500, "ab" * 700, "​ a", "日本語" * 200]
    for _ in range(160):
        out.append("".join(r.choice(words) + r.choice(spaces) for _ in range(r.randrange(60))))
    for _ in range(60):
        out.append("".join(chr(r.choice([r.randrange(1, 128), r.randrange(128, 0x800), r.randrange(0x3000, 0xD7FF), r.randrange(0x10000, 0x11000)])) for _ in range(r.randrange(80))))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_contract(spark, libraries, monkeypatch, parts):
    docs = list(enumerate(texts())) + [(None, "the cat sat"), (7, "the cat"), (7, "the cat"), (None, None)]
    got = alignment.links(spark.createDataFrame(docs, DOCS).repartition(parts), A, B).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain(docs, libraries)
    assert sum(x.n_groups > 3 for x in got) > 150
    assert sum(x.n_best < x.n_links for x in got) > 50


def test_lanes_and_slices(libraries, monkeypatch):
    """Long documents go through many lanes and slices, large groups by their distinct ids."""
    monkeypatch.setattr(alignment, "SLICE", 5)
    r = random.Random(8)
    words = "the of 東京 antidisestablishmentarianism 12345 naïveté ====== ()".split()
    docs = ["".join(r.choice(words) + r.choice([" ", "", "\n"]) for _ in range(r.choice([0, 3, 900]))) for _ in range(12)] + ["=" * 999, "z" * 2000]
    both = alignment._read(A, B)
    both.forget()
    tokens = both.encode(docs)
    for lane in (7, 64, 512):
        monkeypatch.setattr(alignment, "LANE", lane)
        for text, x in zip(docs, tokens, strict=True):
            if not x:
                assert not text
                continue
            a, b = (np.frombuffer(y, "<u2") for y in x)
            ae, be = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
            i, j = alignment.lockstep(ae, be, ae[-1:])
            want, at_a, at_b = np.intersect1d(ae, be, return_indices=True)
            assert (i == at_a).all() and (j == at_b).all() and ae[-1] == len(text.encode()) + 1
    a, b = (np.concatenate([np.frombuffer(x[k], "<u2") for x in tokens if x]) for k in (0, 1))
    ends = np.cumsum([len(t.encode()) + 1 for t in docs if t])
    ae, be = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    i, j = alignment.lockstep(ae, be, ends)
    groups = alignment._Groups(a, b, i, j, np.searchsorted(ends, ae[i], "left"))
    key, times = groups.links()
    want = Counter()
    for g in range(len(i)):
        for u in a[groups.fa[g] : groups.fa[g] + groups.na[g]].tolist():
            for v in b[groups.fb[g] : groups.fb[g] + groups.nb[g]].tolist():
                want[int(groups.doc[g]) << 32 | u << 16 | v] += 1
    assert dict(zip(key.tolist(), times.tolist(), strict=True)) == want
    assert max(groups.na * groups.nb) > alignment.SLICE
    assert [bool(x) for x in groups.digests(len(ends))] == [True] * len(ends)


def test_many_chunks(spark, libraries, monkeypatch):
    """Answers in several parts: more chunks than are added up at a time."""
    monkeypatch.setattr(alignment, "GATHER", 3)
    r = random.Random(6)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gammas", "Delta", "x9"]) for _ in range(r.randrange(30)))) for k in range(90)]
    got = alignment.links(spark.createDataFrame(docs, DOCS).repartition(11), A, B).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain(docs, libraries)


def test_empty_and_other_columns(spark):
    none = alignment.links(spark.createDataFrame([], DOCS), A, B)
    assert none.count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "a"), (2, None, 6, "b")], "doc_id long, text string, n_links int, CHUNK string")
    assert sorted((x.doc_id, x.n_a, x.groups_sha256 == "") for x in alignment.links(df, A, B).collect()) == [(1, 2, False), (2, 0, True)]
    assert alignment.links(df, A, B).columns == none.columns


def test_memory_of_parts(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 40 * alignment.EACH)
    both = alignment._Tokenizers(A, B)
    for k in range(60):
        text = f"word{k} the cat{k % 7} " + "y" * 100
        assert both.encode([text])[0][0] == np.array(both.a.encode(" " + text, add_special_tokens=False).ids, "<u2").tobytes()
        assert len(both.known[0]) <= 26 and len(both.older[0]) <= 26


def test_parts_read_as_one_text(libraries):
    """Thousands of parts at once give what each gives; a part that spoils its lot leaves the others right."""
    r = random.Random(12)
    letters = "etaoinshrdlu'0123.,-_<|>éüßñ中日한あ́\u200b½"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(40)) for _ in range(150)]
    texts += [t[:60] + " x▁y " + t[60:] for t in texts[:3]] + [t + "\n" for t in texts[:3]] + ["<|endoftext|> it's </s>"]
    both = alignment._Tokenizers(A, B)
    got = both.encode(texts)
    for t, x in zip(texts, got, strict=True):
        if "▁" in t:
            assert x is None
        else:
            assert np.frombuffer(x[0], "<u2").tolist() == libraries[0].encode(" " + t, add_special_tokens=False).ids
            assert np.frombuffer(x[1], "<u2").tolist() == libraries[1].encode(t)
