"""Token counts and the codec against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import bpe_codec, token_counts
from lexloom.llm.bpe import PrefixBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
library = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return PrefixBpe(PATH)


@settings(max_examples=1500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, text):
    text = text.encode("utf-8", "ignore").decode()
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want and own.count(text) == len(want)


@settings(max_examples=1500, deadline=None)
@given(st.text("abdeinorstthe'.,1 Σİſ\x1c<|>", max_size=40), st.sampled_from(["", "<|endoftext|>", "<|startoftext|> x"]))
def test_words_and_special_strings(own, text, special):
    text += special + text
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.digest(text)[2] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeinorsté", min_size=1, max_size=25))
def test_counts_within_a_word(own, word):
    import unicodedata

    word = unicodedata.normalize("NFC", word)
    want = [len(library.encode(word[: i + 1], add_special_tokens=False).ids) for i in range(len(word))]
    assert own.word_prefix_counts(word) == want


def test_prefix_table_answers_budgets(spark, docs):
    table = token_counts.token_prefix_counts(docs.limit(60), PATH)
    rows = table.join(docs, "doc_id").select("text", "ends", "counts", token_counts.truncation_point(F.col("ends"), F.col("counts"), 50).alias("cut"), token_counts.within_budget(F.col("counts"), 50).alias("fits")).collect()
    for r in rows:
        whole = len(library.encode(r["text"], add_special_tokens=False).ids)
        assert (r["counts"][-1] if r["counts"] else 0) == whole and r["fits"] == (whole <= 50)
        assert len(library.encode(r["text"].lower()[: r["cut"]], add_special_tokens=False).ids) <= 50


def test_queries_match_the_library(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = token_counts.op1_token_counts(spark, sf).collect()
    codec = {r["doc_id"]: r for r in bpe_codec.op9_bpe_codec(spark, sf).collect()}
    assert len(counts) == len(texts)
    for r in counts:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids), len(texts[r["doc_id"]].encode()), len(ids) > 2048)
        assert codec[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_odd_rows(odd, empty):
    got = token_counts.token_totals(odd, PATH).collect()
    assert len(got) == 9 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert token_counts.token_totals(empty, PATH).count() == 0 == bpe_codec.encode_digest(empty, PATH).count()
    ids = bpe_codec.encode(odd, PATH)
    back = {r["doc_id"]: r["decoded"] for r in bpe_codec.decode(ids, PATH).collect()}
    assert back[2] == "" and back[6].split() == ["1</w>", "2</w>", "3</w>", "4</w>", "5</w>", "6</w>", "!!</w>"]
