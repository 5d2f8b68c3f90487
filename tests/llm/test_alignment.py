"""Operator 13 against whole-text encoding and plain Python sets."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lexloom.llm import tokenizer_alignment as ta
from lexloom.llm.bpe import byte_characters

A, B = public_tokenizers.path(ta.A_FILE), public_tokenizers.path(ta.B_FILE)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(tokens):
    at, out = 0, []
    for x in tokens:
        at += len(x)
        out.append(at)
    return out


def brute(rows, libraries):
    a_lib, b_lib = libraries
    shown, names = {c: b for b, c in byte_characters().items()}, {i: t for t, i in a_lib.get_vocab().items()}
    found, count, best = [], Counter(), Counter()
    for i, text in rows:
        a, b, groups = [], [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_bytes = [bytes(shown[c] for c in names[k]) for k in a]
            b_bytes = [bytes([int(b_lib.id_to_piece(k)[3:5], 16)]) if b_lib.is_byte(k) else b_lib.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a, b = [], []
            else:
                a_ends, b_ends, p, q = ends(a_bytes), ends(b_bytes), 0, 0
                for j in sorted(set(a_ends) & set(b_ends)):
                    m, n = a_ends.index(j, p) + 1, b_ends.index(j, q) + 1
                    groups.append((a[p:m], b[q:n]))
                    p, q = m, n
        links = [(x, y) for g, h in groups for x in g for y in h]
        count.update(set(links))
        found.append((i, len(a), len(b), groups, links))
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    text = lambda groups: ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
    out = [
        (i, a, b, len(g), len(k), sum(count[x] == best[x[0]] for x in k), sum(count[x] for x in k), hashlib.sha256(text(g).encode()).hexdigest() if a else "")
        for i, a, b, g, k in found
    ]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in ta.align(df, A, B).collect()), key=repr)


ODD = [
    "a  b", " leading", "trailing ", "a \n b", "x\n\n  y", "tab\t tab", "don't 's 'll", "<s> </s> <unk> <|endoftext|> <0x0A>", "▁ x▁y", "日本語 テキスト", "é é ﬁ Ａ",
    " nbsp   x", "　 wide", "\x00 nul \x1c sep", "🙂 👩‍👩‍👧", "​ zero​ ﻿", "   ", "\n", "123 4567 89", "a.b,c;d", "᠎ x", "ﬀ ", "x" * 3000, "퟿  \U0010ffff",
]


def test_pieces_give_what_whole_texts_give(spark, libraries):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows, libraries)


def test_tables(spark, docs, sf, libraries):
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(80).collect()]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, libraries)


def test_odd_rows_and_empty(spark, odd, empty, libraries):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows, libraries)
    assert got(empty) == []


def test_parts_and_clearing_change_nothing(monkeypatch):
    rows = [(k, t) for k, t in enumerate([*ODD, None, "", "the cat sat on the mat " * 50, "the cat " * 30])]
    ids, texts = map(list, zip(*rows))
    whole = ta.block(ta.Aligner(A, B), 0, ids, texts)
    for part in (1, 7, 100):
        monkeypatch.setattr(ta, "PART", part)
        assert ta.block(ta.Aligner(A, B), 0, ids, texts) == whole
    monkeypatch.setattr(ta, "PIECES", 3)
    e = ta.Aligner(A, B)
    for _ in range(3):
        assert ta.block(e, 0, ids, texts) == whole


def test_salted_stripes(spark, docs, monkeypatch):
    want = got(docs.limit(60))
    monkeypatch.setattr(ta, "STRIPE_ROWS", 0.4)
    assert got(docs.limit(60)) == want


def test_packing():
    for kind in ("<u1", "<u2", "<u4", "<u8"):
        values = np.array([0, 1, 255, 7])
        assert ta.unpack(ta.pack(values, kind), kind).tolist() == values.tolist()
        assert ta.unpack(ta.pack(values[:0], kind), kind).tolist() == []
