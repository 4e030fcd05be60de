"""Operators on copies and passages (1, 2, 5), against plain versions and on edge rows."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from brute import jaccard_components, passage_components, removed_bytes, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import components, ngram_join, passages, suffix_dedup, suffixes
from corpusflow.session import scratch_path


def _variants(seed=3, n=60):
    """Texts with copies, near copies of several distances, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120, 250]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w += base[0]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("max_block", [2_000_000, 500])
def test_ngram_join_equals_brute_force(spark, max_block):
    rows = _variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = {r[0]: (r[1], r[2]) for r in ngram_join.join(docs, k, percent, max_block).collect()}
        assert got == jaccard_components(rows, k, percent)


def test_ngram_join_whole_table(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    got = {r[0]: (r[1], r[2]) for r in ngram_join.join(small, 3, 90).collect()}
    assert got == jaccard_components(rows, 3, 90)


def test_ngram_join_edges(spark, edge, nothing):
    rows = ngram_join.join(edge, 3, 90).collect()
    assert len(rows) == edge.count()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)}  # empty sets link with nothing
    assert got[4] == {(1, 4)} and got[5] == {(1, 4)}  # A-Z in lower case
    assert got[6] == {(1, 6)}
    assert {c for _, c in got[7] | got[8]} == {7}  # long near copies
    assert {c for _, c in got[10]} == {10} or {c for _, c in got[10]} == {9}
    assert ngram_join.join(nothing, 3, 90).count() == 0


def test_one_of_each_keeps_one_row(spark, edge, nothing):
    left = ngram_join.one_of_each(edge, 5, 80)
    assert left.columns == edge.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert ids.count(4) == 1 and ids.count(10) + ids.count(9) <= 2 and 7 in ids and 8 not in ids
    assert {1, 2, 3, 6, 11} <= set(ids)
    assert ngram_join.one_of_each(nothing, 5, 80).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=14), st.sampled_from([50, 80, 90]))
def test_link_unit_connects_all_similar_pairs(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    links = ngram_join.link_unit(np.arange(len(sets)), np.zeros(len(sets), int), arrays, percent)

    def roots(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
        return [find(i) for i in range(len(sets))]

    similar = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert roots(links) == roots(similar)
    assert all(p in {tuple(sorted(x)) for x in similar} for p in (tuple(sorted(x)) for x in links))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=30), max_size=8), st.integers(1, 26))
def test_equal_suffixes(parts, depth):
    text, at = suffixes.padded([p.encode() for p in parts], depth)
    start = np.concatenate([np.arange(at[i], max(at[i], at[i + 1] - depth + 1)) for i in range(len(parts))] or [np.zeros(0)]).astype(np.int64)
    member, number = suffixes.equal_suffixes(text, start, depth)
    want = {}
    for i, s in enumerate(start):
        want.setdefault(text[s : s + depth].tobytes(), []).append(i)
    got = {}
    for m, c in zip(member, number, strict=True):
        got.setdefault(c, []).append(int(m))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_equals_brute_force(spark, small, hot):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup(small.select("doc_id", "text"), hot=hot).collect()}
    assert got == removed_bytes(rows, 100)


def test_suffix_dedup_periodic_and_short(spark):
    rows = [(1, "ab" * 200), (2, "x" * 99), (3, "x" * 100), (4, "x" * 350), (5, "é" * 120), (6, None), (7, "ab" * 60 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup(docs).collect()}
    assert got == removed_bytes(rows, 100)


def test_suffix_dedup_edges(spark, edge, nothing):
    rows = suffix_dedup.dedup(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1][0][1:] == (0, 0, 0, empty) and by[2][0][1:] == (0, 0, 0, empty)
    assert by[8][0]["n_removed"] > 0 and by[9][0]["n_removed"] == 0 and by[10][0]["n_removed"] > 400
    assert by[10][0] == by[10][1]  # repeated rows: one document
    assert suffix_dedup.dedup(nothing).count() == 0


def test_suffix_dedup_gives_text_and_columns(spark, edge):
    out = suffix_dedup.dedup(edge, keep=("doc_id", "text", "lang", "source"))
    assert {"text", "lang", "source"} <= set(out.columns)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[4] == "one" and "pass40" not in got[10] and "pass40" in got[9]


def test_near_passages_equal_passages_and_whole_table(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(small.select("doc_id", "text")).collect()}
    want = passage_components(rows)
    # the brute version only looks at windows of the least length, so it may join less, never more
    groups = {}
    for d, c in want.items():
        groups.setdefault(c, set()).add(d)
    assert all(len({got[d] for d in g}) == 1 for g in groups.values())
    assert sum(got[d] != want[d] for d in got) <= 1


def test_near_passages_edited(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(80)]
    edited = list(passage)
    for i in (20, 60):
        edited[i] = "changed"
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(1, " ".join(fill(90) + passage + fill(30))), (2, " ".join(fill(10) + edited + fill(99))), (3, " ".join(fill(200))), (4, " ".join(fill(50) + passage[:30] + fill(80)))]
    got = {r["doc_id"]: (r["class_id"], r["n_passages"]) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=1).collect()}
    assert got[1][0] == 1 and got[2][0] == 1 and got[2][1] >= 1
    assert got[3] == (3, 0) and got[4] == (4, 0)


def test_near_passages_with_words_put_in(spark):
    rng = random.Random(12)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(30):  # 4 words in the middle of 60 (Jaccard 52/64), in either order
        passage = fill(60)
        edited = passage[:30] + fill(4) + passage[30:]
        pair = (passage, edited) if i % 2 else (edited, passage)
        rows += [(2 * i + side, " ".join(fill(60) + p + fill(60))) for side, p in enumerate(pair)]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] in (d, d - d % 2) for d in got)
    assert sum(got[2 * i + 1] == 2 * i for i in range(30)) >= 27


@pytest.mark.parametrize("hot", [passages.HOT, 1])
def test_near_passages_misses_none_at_the_threshold(spark, hot):
    rng = random.Random(77)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows, far = [], 0
    for i in range(160):
        passage = fill(50)
        edited = list(passage)
        edited[25] = "other"  # 41 of 51 shingles: 0.804
        if i % 4 == 1:  # parts change places: 42 of 50
            passage = fill(50)
            edited = passage[25:] + passage[:25]
        elif i % 8 == 2:  # 38 of 54: none
            edited[10], edited[40], far = "this", "that", far + 1
        rows += [(2 * i, " ".join(fill(40) + passage + fill(40))), (2 * i + 1, " ".join(fill(9) + edited + fill(70)))]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert far == 20
    assert got == {d: d - d % 2 if (d // 2) % 8 != 2 else d for d in got}


def test_near_passages_with_hot_passage_and_repeats(spark):
    rng = random.Random(8)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    short, long, line = fill(40), fill(60), fill(12)
    rows = [(i, " ".join(fill(5) + short + fill(50))) for i in range(40)]  # common, shorter than a passage
    rows += [(100 + i, " ".join(fill(5) + long[: i + 3] + ["x"] + long[i + 4 :] + fill(9))) for i in range(50)]  # all edited differently
    rows += [(200 + i, " ".join(fill(20) + line * (5 + i) + fill(20))) for i in range(2)]  # a repeated line: few distinct shingles
    rows += [(300, " ".join(fill(20) + line + fill(60)))]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=10).collect()}
    assert got == {d: d if d < 100 or d == 300 else d - d % 100 for d in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=4, max_size=14), st.lists(st.integers(0, 9), min_size=4, max_size=14))
def test_near_intervals_equals_all_intervals_with_repeats(x, y):
    def cuts(z):
        return {frozenset(z[i:j]) for i in range(len(z)) for j in range(i + 4, len(z) + 1)}

    want = any(100 * len(a & b) >= 80 * len(a | b) for a in cuts(x) for b in cuts(y))
    assert (passages.near_intervals(np.array(x, np.uint64), np.array(y, np.uint64), 4, 80) is not None) == want
    assert passages._distinct(np.array(x, np.uint64), 4).tolist() == [len(set(x[i : i + 4])) for i in range(len(x) - 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=4, max_size=11), st.lists(st.tuples(st.integers(0, 10), st.integers(0, 30), st.booleans()), max_size=4))
def test_similar_equals_all_intervals(x, edits):
    y = list(x)
    for at, value, put_in in edits:
        y[at % len(y) : at % len(y) + (not put_in)] = [value]
    span = 4

    def cuts(z):
        return [set(z[i:j]) for i in range(len(z)) for j in range(i + span, len(z) + 1)]

    want = any(100 * len(a & b) >= 80 * len(a | b) for a in cuts(x) for b in cuts(y))
    assert passages.similar(np.array(x, np.uint64), np.array(y, np.uint64), span, 80) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 12), min_size=4, max_size=16), st.lists(st.integers(0, 12), min_size=4, max_size=16)), min_size=1, max_size=5))
def test_filter_of_many_pairs_loses_none(pairs):
    xs, ys = ([np.array(p[side], np.uint64) for p in pairs] for side in (0, 1))
    needs = ([int(passages._distinct(z, 4).min()) for z in side] for side in (xs, ys))
    kept = passages._may_be_near(xs, ys, *needs, 4, 80)
    assert all(k or passages.near_intervals(x, y, 4, 80) is None for x, y, k in zip(xs, ys, kept, strict=True))


def test_filter_of_many_pairs_sorts_out():
    x = np.arange(100, dtype=np.uint64)
    rare, close, far = x.copy(), x.copy(), x + np.uint64(1000)
    rare[::6] += np.uint64(1000)  # 83 % of the tokens, but 0.8 of no union
    rare[50:], close[20:60:10] = np.arange(5000, 5050), np.arange(7000, 7004)
    assert passages._may_be_near([x] * 4, [rare, close, far, x], [46] * 4, [46] * 4).tolist() == [False, True, False, True]


def test_coverage_of_many_rows_at_once():
    spans = [[(0, 1), (49, 2), (10, 3)], [(100, 1), (0, 1), (51, 1)], [(7, 5)]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    rows = pa.array([[{"start": s, "n": n} for s, n in x] for x in spans], kind)
    (got,) = passages._coverage([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), rows], ["o", "k", "spans"])])
    assert got.column("n_covered").to_pylist() == [100, 149, 54] and got.column("n_passages").to_pylist() == [1, 2, 1]


def test_pairs_of_regions_are_summed_in_slices(spark, monkeypatch):
    rng = random.Random(31)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for g in range(2):
        common = fill(80)
        for i in range(30):  # all changed at other places, most below the threshold
            own = list(common)
            for at in rng.sample(range(80), 2 + i % 5):
                own[at] = fill(1)[0]
            rows.append((100 * g + i, " ".join(fill(9) + own + fill(30))))
    docs, written = spark.createDataFrame(rows, "doc_id long, text string"), []

    def counted(df, name, write=passages.materialize):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    monkeypatch.setattr(passages, "PART", 64)
    whole = sorted(map(tuple, passages.near_passages(docs).collect()))
    (_, (_, pairs)) = [x for x in written if x[0] == "passage_pairs"]
    written.clear()
    monkeypatch.setattr(passages, "SLICE", 1)
    assert sorted(map(tuple, passages.near_passages(docs).collect())) == whole
    _, *slices, (_, again) = [x for x in written if x[0] == "passage_pairs"]
    assert len(slices) > 2 and max(n for _, n in slices) < pairs
    assert sum(n for _, n in slices) == again == pairs > 100


def test_tokens_of_one_label_make_no_pairs():
    kinds = (("token", np.uint64), ("unit", np.int64), ("label", np.int64), ("need", np.uint8), ("hot", np.uint32))
    columns = ([7, 7, 7, 8, 8, 9], [11, 12, 13, 11, 12, 13], [1, 1, 2, 1, 1, 2], [46] * 6, [0] * 6)
    posted = pa.RecordBatch.from_pylist([{"part": 0} | {c: np.array(v, kind).tobytes() for (c, kind), v in zip(kinds, columns, strict=True)}])
    (apart,) = passages._tokens_apart([posted])
    assert apart.column("pairs").to_pylist() == [2] and np.frombuffer(apart.column("unit")[0].as_py(), np.int64).tolist() == [11, 12, 13]
    got = [tuple(r.values())[:2] for some in range(2) for b in passages._meet([apart], some, 2) for r in b.to_pylist()]
    assert sorted(got) == [(11, 13), (12, 13)]
    assert [tuple(r.values())[:2] for b in passages._meet_first([posted]) for r in b.to_pylist()] == [(11, 13)]


def test_near_passages_removes_tables_that_are_done_with(spark, small):
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = set(folder.glob("passage_*"))
    passages.near_passages(small.select("doc_id", "text"))
    left = {p.name.split("-")[0] for p in set(folder.glob("passage_*")) - before}
    assert "passage_units" in left and not left & {"passage_tokens", "passage_marks", "passage_regions"}


def test_near_passages_edges(spark, edge, nothing):
    rows = passages.near_passages(edge).collect()
    assert len(rows) == edge.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[8]["class_id"] == 7 and got[10]["class_id"] == 9 and got[9]["n_covered"] >= 50
    assert got[1]["class_id"] == 1 and got[4]["n_passages"] == 0
    assert passages.near_passages(nothing).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 999), (5000, 4000), (4000, 3000), (7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = dict(tuple(r) for r in components.components(df).collect())
    assert {got[i] for i in range(301)} == {0} and got[1000] == 999 and got[5000] == 3000
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_short_texts():
    assert shingles("A b", 3) == {("a", "b")} and shingles(" ", 3) == frozenset()


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=120), st.data(), st.sampled_from([80, 90]))
def test_similar_sets_have_an_equal_part(base, data, percent):
    x = sorted(base)
    y = [v for v in x if data.draw(st.floats(0, 1)) > 0.06] + data.draw(st.lists(st.integers(2 * 10**6, 3 * 10**6), max_size=6))
    y = sorted(set(y))
    if not y or 100 * len(set(x) & set(y)) < percent * len(set(x) | set(y)):
        return
    ident = np.array(x + y, np.uint64)
    row, sign = ngram_join.part_signatures(ident, np.array([0, len(x), len(x) + len(y)]), percent)
    assert set(sign[row == 0].tolist()) & set(sign[row == 1].tolist())


@pytest.mark.parametrize("percent", [80, 90])
def test_small_similar_sets_share_a_part(percent):
    rng = np.random.default_rng(9)
    lost = 0
    for n in range(1, 31):
        for _ in range(300):
            x = rng.integers(0, 1 << 60, n).astype(np.uint64)
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            y = np.concatenate([x[gone:], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + n * (100 - percent) // percent))).astype(np.uint64)])
            both = n - gone
            if not len(y) or 100 * both < percent * (n + len(y) - both):
                continue
            row, sign = ngram_join.part_signatures(np.concatenate([x, y]), np.array([0, n, n + len(y)]), percent)
            lost += not set(sign[row == 0].tolist()) & set(sign[row == 1].tolist())
    assert lost == 0


def test_suffix_dedup_shared_strings_of_every_length(spark):
    """Pairs that share 1 to 150 bytes, each pair a table of its own, so that a block may remove nothing."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (1, 40, 55, 65, 75, 85, 95, 99, 100, 101, 120, 150):
        shared = "".join(rng.choice(letters) for _ in range(n))
        rows = [(i, f"{i}" * 9 + "".join(rng.choice(letters) for _ in range(60)) + shared + f"<{i}>" * 30) for i in (1, 2)]
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == removed_bytes(rows, 100), n


def test_suffix_dedup_repeated_id(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = text(130)
    rows = [(1, text(50) + shared), (1, text(50) + shared), (1, text(70) + shared), (2, shared + text(20))]
    out = sorted(tuple(r) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # rows of one id are compared by start: equal strings at the same start both stay
    assert [r[:3] for r in out] == [(1, 180, 0), (1, 180, 0), (1, 200, 130), (2, 150, 130)]
