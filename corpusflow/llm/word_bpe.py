"""Byte-pair encoding with word ends, encoded and decoded in batched numpy merge rounds.

A tokenizer file (JSON: vocabulary, merges, added tokens, normaliser, splitting rule) is read once on the
driver and sent to the tasks; its size is checked. A task takes spans of whole texts:

1. *Words.* Added tokens are cut out of the raw text, the rest goes through the file's own normaliser, and
   the file's splitting rule is applied to all code points of the span at once: runs of letters, single
   numerals, runs of other characters, and the contractions that an apostrophe opens. Which code point is a
   letter, a numeral, a space or none of them is asked of the file's splitter, once a code point and worker.
2. *Distinct words.* Words of up to ``PACKED`` bytes are packed into integers and each distinct one is
   encoded once a span; what shares a hash is compared in full. Longer words are encoded as they come.
3. *Merge rounds.* The symbols of all words stand in one flat array. In each round the keys of all adjacent
   pairs are looked up by binary search in the sorted keys of the merges, a segmented minimum finds each
   word's lowest rank, all its pairs of that rank are merged (left to right where they overlap), and words
   without a pair leave the array. A merge that makes a token stands in the file before those that use it (checked),
   so merging all equal pairs at once gives the same result as one after the other.
4. *Ids* of the words are put back in text order. Decoding joins the tokens' strings by spaces, which is what
   the library does for a file without a decoder.

Nothing is shuffled, and a task holds one span or the longest text, whichever is larger.

Defined cases: a null text counts as empty and has no ids; texts without words (white space only) too;
repeated rows each give a row; other columns are ignored; an empty table gives an empty result; ids outside
the vocabulary are an error in decoding. Files of another kind (normalised or stripping added tokens, another
splitting rule, unknown tokens, dropout, a decoder) are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import tokens as tk
from corpusflow.llm.common import read, with_columns

TOKENIZER = "word_bpe_49k.json"
#: Bytes of texts encoded together, bytes of a word that is looked up among the span's distinct words, and
#: the largest tokenizer file that is sent to the tasks.
SPAN_BYTES, PACKED, MOST_FILE_BYTES = 1 << 20, 16, 64 << 20
#: The splitting rule that ``WordBpe.words`` implements, and the contractions in it.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDS_1, ENDS_2 = "stmd", ("re", "ve", "ll")
LETTER, NUMERAL, SPACE, OTHER = 0, 1, 2, 3
#: What the normaliser does (composed form, white space, lower case) is plain below U+0250, where every character is composed.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
_BEYOND, _BLANKS = re.compile("[^\x00-\u024f]"), re.compile("[ \t-\r\x85\xa0]+")
_NO_RANK = np.iinfo(np.int32).max


def tokenizer_file(path: str = "") -> str:
    """The content of a tokenizer file: by its path, or else the public one of this operator."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        content = f.read(MOST_FILE_BYTES + 1)
    if len(content) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} characters")
    return content


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file as flat arrays; built once in each worker."""

    def __init__(self, content: str):
        t = json.loads(content)
        m = t["model"]
        split, level = t["pre_tokenizer"]["pretokenizers"]
        normal = tuple(n["type"] for n in t["normalizer"]["normalizers"])
        plain = m["type"] == "BPE" and normal == NORMALIZERS and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        kind = (split["type"], split["pattern"].get("Regex"), split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"])
        if not plain or t["decoder"] or kind != ("Split", RULE, "Removed", True, "ByteLevel", False, False):
            raise ValueError("not a word BPE tokenizer file of the known kind")
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in t["added_tokens"]):
            raise ValueError("added tokens that are normalised or strip their surroundings are not supported")
        self.content, suffix = content, m["end_of_word_suffix"] or ""
        vocabulary = m["vocab"]
        added = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.added = added
        size = 1 + max([*vocabulary.values(), *added.values()])
        strings: list[bytes | None] = [None] * size
        for w, i in (vocabulary | added).items():
            strings[i] = w.encode()
        self.strings = np.array(strings, object)
        self.cut = re.compile("|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None

        chars = byte_characters()
        self.inner = np.array([vocabulary[c] for c in chars], np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in chars], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        born = np.full(size, -1, np.int64)
        born[made] = np.arange(len(made))
        rank = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("a merge uses a token that a later merge makes")
        self.size = size
        order = np.argsort(left * size + right)
        self.keys, self.ranks, self.made = (left * size + right)[order], rank[order].astype(np.int32), made[order]
        self.kinds = np.full(0x110000, -1, np.int8)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.content)

    def normal(self, text: str) -> str:
        """The text as the file's normaliser gives it."""
        if _BEYOND.search(text):
            return self.library.normalizer.normalize_str(text)
        return _BLANKS.sub(" ", text).lower()

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Letter, numeral, space or other, of each code point."""
        kind = self.kinds[points]
        if (kind < 0).any():
            for c in np.unique(points[kind < 0]).tolist():
                # twice between a numeral and a letter: the lengths of what the splitter gives tell the class
                got = [e - s for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str("1" + chr(c) * 2 + "a")]
                self.kinds[c] = {(1, 3): LETTER, (1, 1, 1, 1): NUMERAL, (1, 1): SPACE, (1, 2, 1): OTHER}[tuple(got)]
            kind = self.kinds[points]
        return kind

    def words(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point and the one after the last of each word; words never cross a piece's start."""
        n = len(points)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none
        kind = self.classes(points)
        edge = np.zeros(n + 3, bool)
        edge[starts] = True
        edge[[0, n]] = True
        new = edge.copy()
        new[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMERAL)
        # contractions: an apostrophe that opens a word, and the letters behind it
        opens = np.flatnonzero((points == 0x27) & new[:n])
        at = lambda k: np.where(opens + k < n, points[np.minimum(opens + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in ENDS_1]) & ~edge[opens + 1]
        long_ = np.zeros(len(opens), bool)
        for a, b in ENDS_2:
            long_ |= (one == ord(a)) & (two == ord(b))
        long_ &= ~edge[opens + 1] & ~edge[np.minimum(opens + 2, n)]
        new[opens[short | long_] + 1] = False
        new[opens[short] + 2] = True
        new[opens[long_] + 3] = True
        first = np.flatnonzero(new[:n])
        end = np.append(first[1:], n)
        keep = kind[first] != SPACE
        return first[keep], end[keep]

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as byte ranges: the ids of all words in a row, and how many each has."""
        head = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(head, size)
        sym = self.inner[data[np.repeat(start, size) + inner]]
        sym[head + size - 1] = self.last[data[start + size - 1]]
        word = np.repeat(np.arange(len(size)), size)
        done_sym, done_word = [], []
        while len(sym):
            pair = np.append(sym[:-1].astype(np.int64) * self.size + sym[1:], -1)
            pair[:-1][word[1:] != word[:-1]] = -1
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pair, self.ranks[at], _NO_RANK)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(head, len(word)))
            least = np.minimum.reduceat(rank, head)
            ended = np.repeat(least == _NO_RANK, count)
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
            hit = np.flatnonzero((rank == np.repeat(least, count)) & ~ended)
            if not len(hit):
                break
            # equal pairs that overlap (runs of one symbol): every other one, from the left
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            stay = ~ended
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        ids = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        owner = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(size))

    def distinct(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words to encode, and for each word which of them it equals."""
        padded = np.concatenate([data, np.zeros(PACKED, np.uint8)])
        wide = np.ndarray((len(data) + PACKED - 8,), "<u8", padded, 0, (1,))
        mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        low = wide[start] & mask[np.minimum(size, 8)]
        high = wide[np.minimum(start + 8, len(wide) - 1)] & mask[np.clip(size - 8, 0, 8)]
        h = tk.mix64(low + tk.mix64(high + size.astype(np.uint64)))
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        rep = first[same]
        alone = (size > PACKED) | (low != low[rep]) | (high != high[rep]) | (size != size[rep])
        places = np.concatenate([first, np.flatnonzero(alone)])
        which = np.where(alone, len(first) + np.cumsum(alone) - 1, same)
        used = np.unique(which)
        back = np.zeros(len(places), np.int64)
        back[used] = np.arange(len(used))
        return places[used], back[which]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (and the last one's end)."""
        pieces, piece_row, special, special_row = [], [], [], []
        for row, text in enumerate(texts):
            at = 0
            for m in self.cut.finditer(text or "") if self.cut else ():
                pieces.append(self.normal(text[at : m.start()]))
                piece_row.append(row)
                special.append((len(pieces), self.added[m.group()]))
                special_row.append(row)
                at = m.end()
            pieces.append(self.normal(text[at:]) if text else "")
            piece_row.append(row)
        whole = "".join(pieces)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        first, end = self.words(points, starts[starts < len(points)])
        data = np.frombuffer(whole.encode(), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        piece = np.searchsorted(starts, first, "right") - 1
        row = np.array(piece_row, np.int64)[piece]
        if len(first):
            start, size = offset[first], offset[end] - offset[first]
            place, which = self.distinct(data, start, size)
            ids, count = self.merge(data, start[place], size[place])
        else:
            which, ids, count = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        if special:  # as words of one id each, between the pieces
            which = np.concatenate([which, len(count) + np.arange(len(special))])
            ids = np.concatenate([ids, np.array([i for _, i in special], np.int32)])
            count = np.concatenate([count, np.ones(len(special), np.int64)])
            order = np.argsort(np.concatenate([2 * piece, [2 * p - 1 for p, _ in special]]), kind="stable")
            which, row = which[order], np.concatenate([row, special_row])[order]
        at = np.cumsum(count) - count
        n = count[which]
        head = np.cumsum(n) - n
        out = ids[np.repeat(at[which] - head, n) + np.arange(n.sum())]
        per_row = np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per_row)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one sequence of ids, in UTF-8."""
        found = self.strings[ids].tolist()
        return b" ".join(found)


_built: dict[int, WordBpe] = {}


def _model(content: str) -> WordBpe:
    """One model a worker and file."""
    key = hash(content)
    if key not in _built:
        _built[key] = WordBpe(content)
    return _built[key]


def _spans(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = tk.text_bytes(batch.column("text"))
        for lo, hi, _, _ in tk.spans(np.zeros(0, np.uint8), offsets, span):
            yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, path: str = "", span: int = SPAN_BYTES) -> DataFrame:
    """docs: doc_id, text -> doc_id, ids (array of int)."""
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _spans(batches, span):
            ids, offsets = _model(content.value).encode(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = "") -> DataFrame:
    """encoded: doc_id, ids -> doc_id, text (null or no ids: the empty text)."""
    content = encoded.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _model(content.value)
            texts = [model.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return with_columns(encoded, {"doc_id": "long", "ids": "array<int>"}).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str = "", span: int = SPAN_BYTES) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_tokens, digests of the ids and of the text decoded from them."""
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _spans(batches, span):
            model = _model(content.value)
            ids, offsets = model.encode(part.column("text").to_pylist())
            of_ids, of_text = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = ids[lo:hi]
                of_ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(model.decode(own)).hexdigest())
            columns = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
