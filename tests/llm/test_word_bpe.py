"""Operator 12 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import word_bpe

MODEL = word_bpe.WordBpe(word_bpe.tokenizer_file())
LIBRARY = Tokenizer.from_file(public_tokenizers.path(word_bpe.TOKENIZER))


def _library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def _same(texts):
    ids, offsets = MODEL.encode(texts)
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]]
        assert (own.tolist(), MODEL.decode(own).decode()) == _library(text), text


def test_special_cases():
    _same(["", None, "   ", "a", "don't 's's ''s 'llama 're've 'l 'r 'll", "a<|endoftext|>b<|endoftext|>'s ' s", "<|startoftext|>", "<|EndOfText|>"])
    _same(["aaaa" * 99, "abab" * 77 + "a", "İẞΑΣ ΑΣ x́\u0085 12 ½ ³", "'", "'s", "a'", "1's2", "\x00\x00a\x00", "é", "́a"])
    _same(["s", "́", "'", "s", "<|endoftext|>", "s"])  # neighbours of one span do not touch


def test_random_texts():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ll", "l", "v", "e", "d", " ", "1", "é", "́", "!", "#", "中", "<|endoftext|>", "A", "Σ", "\n", "\U0001f600", "‍", "\x85"]
    for _ in range(30):
        _same(["".join(rng.choice([*parts, chr(rng.randrange(1, 0xD000)), chr(rng.randrange(0xE000, 0x30000))]) for _ in range(rng.randrange(60))) for _ in range(40)])


def test_plain_and_other_characters():
    low = [chr(c) for c in range(1, 0x250)]
    _same(["a".join(low), "1".join(low), " ".join(low), "".join(low), *("x" + c + c + "Y" for c in low)])
    some = [chr(c) for c in range(0x250, 0x3000) if not 0xD800 <= c < 0xE000]
    _same(["a".join(some), "1".join(some)])


def test_query_equals_library(spark, small):
    got = {r[0]: tuple(r)[1:] for r in word_bpe.op12_word_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in small.collect():
        ids, text = _library(r["text"])
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.pop(r["doc_id"]) == (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_edges(spark, edge, nothing):
    rows = word_bpe.digests(edge, span=1000).collect()
    want = sorted((r["doc_id"] or 0, len(_library(r["text"])[0])) for r in edge.collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == want
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, empty, empty)}
    assert word_bpe.digests(nothing).count() == 0 and word_bpe.encode(nothing).count() == 0


def test_encode_and_decode_tables(spark, edge):
    encoded = word_bpe.encode(edge)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in word_bpe.decode(encoded).collect())
    assert got == sorted((r["doc_id"] or 0, _library(r["text"])[1]) for r in edge.collect())


def test_other_files_are_refused():
    for name in ("byte_bpe_50k.json",):
        with pytest.raises((ValueError, KeyError, TypeError)):
            word_bpe.WordBpe(word_bpe.tokenizer_file(public_tokenizers.path(name)))
