import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlens.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.Vocabulary(json.loads(bpe.load(PATH))))


def agree(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = ENCODER.ids(text)
    assert got == want
    assert ENCODER.decode(got) == ENCODER.packed(text)[1] == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "S", "'", "'s", "'LL", "é", "É", "İ", "ſ", "K", "Σ", "ς", "中", "\x1c", "\x1f", "\x85", "\xa0", "\u200b", "\u2003",
     " ", "\t", "\n", "1", "½", "²", "<|endoftext|>", "<|startoftext|>", "<|", "!!", "_", "e", "\u0301", "🙂", "\x00",
     "ﬁ", "ǅ", "가", "\ufeff", "the", "ing", "THE"]), max_size=14).map("".join))
def test_odd_texts_agree_with_the_library(text):
    agree(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_agrees_with_the_library(text):
    agree(text)


def test_every_code_point_agrees_with_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 500):
        part = points[lo:lo + 500]
        text = " ".join(f"a{x}b {x}{x} 1{x}!" for x in part)
        if ENCODER.ids(text) != LIBRARY.encode(text, add_special_tokens=False).ids:
            for x in part:  # name it
                agree(f"a{x}b {x}{x} 1{x}!")


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, "th" * 9_000 + "!" * 3_000, "<|endoftext|>" * 500])
def test_long_parts(text):
    agree(text)


def test_memory_of_parts_does_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    small = bpe.Encoder(ENCODER.vocabulary)
    text = " ".join(f"word{i % 7} some{i % 11}" for i in range(200))
    assert small.packed(text) == ENCODER.packed(text)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op4_bpe(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_hard_rows(clashing, empty):
    got = bpe.encode(clashing, PATH, keep=("doc_id", "text")).collect()
    for r in got:
        assert r.ids == LIBRARY.encode(r.row.text or "", add_special_tokens=False).ids
    assert bpe.digests(empty, PATH).count() == 0
    assert bpe.encoded(clashing, PATH, keep=("doc_id", "lang")).columns == \
        ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
