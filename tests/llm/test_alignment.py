"""Operator 11 against a plain version over the libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusflow.llm import alignment
from corpusflow.llm.word_bpe import byte_characters, tokenizer_file

A = Tokenizer.from_file(public_tokenizers.path(alignment.FILE_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.FILE_B))
BYTE = {c: b for b, c in enumerate(byte_characters())}


def _tokens(text):
    """[(id, bytes)] of both, or nothing where a text does not come back."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()
    b = [(i, piece(i)) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def _groups(text):
    a, b = _tokens(text)
    out, i, j = [], 0, 0
    while i < len(a):
        ga, gb, na, nb = [], [], 0, 0
        while not ga or na != nb:
            if na <= nb:
                ga.append(a[i][0])
                na += len(a[i][1])
                i += 1
            else:
                gb.append(b[j][0])
                nb += len(b[j][1])
                j += 1
        out.append((ga, gb))
    return out


def _expected(rows):
    texts = {t: _groups(t) for _, t in rows}
    count = {}
    for _, t in rows:
        for pair in {(x, y) for ga, gb in texts[t] for x in ga for y in gb}:
            count[pair] = count.get(pair, 0) + 1
    high = {}
    for (x, _), n in count.items():
        high[x] = max(high.get(x, 0), n)
    out = []
    for doc, t in rows:
        links = [(x, y) for ga, gb in texts[t] for x in ga for y in gb]
        line = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in texts[t])
        a, b = (sum(len(g[k]) for g in texts[t]) for k in (0, 1))
        digest = hashlib.sha256(line.encode()).hexdigest() if line else ""
        out.append((doc, a, b, len(texts[t]), len(links), sum(count[p] == high[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out, count, high


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def _texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", " of", "ing", "é", "中", "▁", "'s", " ", "  ", "\n", "12", "<s>", "<|endoftext|>", "<0x41>", "\x00", "\U0001f600", "!", "tion", "ê", "word", "́", "\x1c"]
    return ["".join(rng.choice(parts if rng.random() < 0.5 else parts[:5] + [" "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_faster_library_gives_the_same_ids():
    aligner = alignment.Aligner(tokenizer_file(public_tokenizers.path(alignment.FILE_A)), b"")
    some = [chr(c) for c in range(1, 0x3400)] + [chr(c) for c in range(0x1F000, 0x1FB00)]
    for t in [*_texts(1, 400), *("a" + c + c + "1" + c + " " + c + "a  !" + c + "'s" for c in some)]:
        assert aligner.byte_level.encode_ordinary(" " + t) == A.encode(" " + t, add_special_tokens=False).ids


@pytest.mark.parametrize(("block", "wide"), [(alignment.BLOCK_BYTES, alignment.WIDE), (300, 1)])
def test_equals_plain_version(spark, monkeypatch, block, wide):
    monkeypatch.setattr(alignment, "WIDE", wide)
    texts = _texts(2, 150)
    rows = [(i, texts[i % 120]) for i in range(150)] + [(7, texts[7]), (None, texts[7]), (900, None), (901, ""), (902, " "), (903, "▁"), (904, "a" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, count, high = _expected(rows)
    assert _sorted(alignment.measures(docs, block_bytes=block).collect()) == _sorted(want)
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.pair_counts(docs, block_bytes=block).collect()}
    assert got == {p: (n, n == high[p[0]]) for p, n in count.items()}


def test_query_whole_table(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert _sorted(alignment.op11_alignment(spark, "/root/testdata/sf0.001").collect()) == _sorted(_expected(rows)[0])


def test_edges(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert _sorted(alignment.measures(edge).collect()) == _sorted(_expected(rows)[0])
    assert alignment.measures(nothing).count() == 0 and alignment.pair_counts(nothing).count() == 0
    assert alignment.measures(edge.where("doc_id < 4")).count() == 3
