"""Operators on single rows and small joins (6, 7, 8, 9)."""

import random
import re
import time

import numpy as np
import pytest

from corpusflow.llm import decontaminate, license_scan, mixing, rules


def _counts(text):
    """What op9 counts, the plain way."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rules_counts(spark, edge):
    texts = [t for t in ("a b c d e f a b c d e", "x x x x x x x", "a\na\n\n \na\r", "#*$%&|<> ä", "a b c d e a b c d e a b", " ", None, "one two three four five")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in rules.apply_rules(docs).collect()}
    assert got == {i: _counts(t) for i, t in enumerate(texts)}


def test_rules_verdict_and_edges(spark, edge, nothing):
    rows = rules.apply_rules(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["broken"])
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["base_failed"] and got[9]["n_words"] == 72 and not got[9]["base_failed"]
    assert rules.apply_rules(nothing).count() == 0


def test_rules_compile_to_one_projection(spark, small):
    plan = rules.apply_rules(small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_license_scan_edges(spark, edge, nothing):
    rows = license_scan.scan(edge).collect()
    assert len(rows) == edge.count()
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows}[1] == 0
    assert license_scan.scan(nothing).count() == 0


def test_license_scan_phrases_and_templates(spark):
    rows = [
        (1, "the MIT\nLicense and MIT license, Apache-License"),
        (2, "Released under MIT the License."),  # other order: no phrase, but the template's words
        (3, "mit licenses"),
        (4, "x GNU General Public License y General public LICENSE"),
        (5, "Licensed under CC BY-NC 4.0."),
        (6, "licensed under something else 4.0"),
        (7, "KK mit license"),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (8, 3, 1, 6, "apache,mit")
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "mit" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0
    assert got[4]["n_base"] == 2 and got[4]["base_labels"] == "gpl"
    assert got[5]["labels"] == "cc-by-nc" and got[6]["labels"] == ""
    assert got[7]["n_base"] == 1 and got[7]["first_word"] == 1


def test_rules_bullets_only_start_lines(spark):
    words = " ".join(f"the{i}" for i in range(60))
    rows = [(1, f"- one\r- two\x85- {words}"), (2, f"- one\n- two\n- {words}"), (3, f"one - two\n* three {words}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = {r["doc_id"]: r["n"] for r in d.select("doc_id", rules.measures(d["text"])["n_bullets"].alias("n")).collect()}
    assert m == {1: 1, 2: 3, 3: 1}


def test_license_scan_wrapped_notices(spark):
    rows = [
        (1, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"),
        (2, " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"),
        (3, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
        (4, "all the\n" + "other words\n" * 20 + "rights are\nreserved"),
        (None, "Copyright. All\nrights\nreserved."),
        (None, "Copyright. All\nrights\nreserved."),
    ]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in out}
    assert len(out) == 6
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("mpl", 1.0), 4: ("", 0.0), None: ("proprietary", 1.0)}


def test_license_join_equals_all_pairs(spark):
    rng = random.Random(1)
    templates = [(f"t{i}", " ".join(rng.sample([f"w{j}" for j in range(30)], rng.randint(2, 9)))) for i in range(12)]
    docs = [(i, "\n".join(" ".join(rng.sample([f"w{j}" for j in range(30)], rng.randint(1, 25))) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame([(i, 0, t) for i, t in docs], "doc_id long, key long, text string")
    got = {(r["doc_id"], r["block"], r["label"]) for r in license_scan.match_templates(df, templates, 0.7).collect()}
    want = set()
    for i, t in docs:
        for b, line in enumerate(t.split("\n")):
            for label, body in templates:
                s = set(body.split())
                if len(s & set(line.split())) >= -(-7 * len(s) // 10):
                    want.add((i, b, label))
    assert got == want


def test_license_blocks_equal_all_lines_and_runs(spark):
    rng = random.Random(11)
    words = [f"w{j}" for j in range(40)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randint(2, 9)))) for i in range(10)]
    width = max(len(b.split()) for _, b in templates)
    docs = []
    for i in range(80):
        lines = [" ".join(rng.choice(words + ["x", "y", "z"] * 20) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        if i % 3 == 0:  # a template wrapped over lines, some of its words changed
            body = templates[i % 10][1].split()
            body[rng.randrange(len(body))] = rng.choice(["x", body[0]])
            lines.insert(rng.randrange(4), " ".join(body[: len(body) // 2]) + "\n# " + " ".join(body[len(body) // 2 :]))
        docs.append((i, "\n".join(lines).upper() if i % 7 == 0 else "\n".join(lines)))
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "\u212a " + templates[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], m["label"]): m["containment"] for r in license_scan.match_texts(df, templates, 0.7).collect() for m in r["matches"]}
    want = {}
    for i, t in docs:
        w = re.findall(license_scan.WORD, (t or "").lower())
        blocks = [re.findall(license_scan.WORD, x.lower()) for x in (t or "").split("\n")] + [w[j : j + width] for j in range(len(w))]
        for label, body in templates:
            s = set(body.split())
            n = max((len(s & set(b)) for b in blocks), default=0)
            if n >= -(-7 * len(s) // 10):
                want[i, label] = n / len(s)
    assert got == pytest.approx(want) and len(want) > 20


def test_license_scan_is_linear_in_the_text(spark):
    notice = "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided"
    body = " ".join(f"use{i % 9} in source and binary or w{i}" for i in range(4_000))  # 28,000 words, most of them template words
    rows = [(i, body + "\n" + notice) for i in range(4)] + [(9, body)]
    started = time.time()
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "bsd", 2: "bsd", 3: "bsd", 9: ""} and time.time() - started < 60


def _dealt(sizes, weights=(3, 1, 2), share=1.5, copies=2):
    """Targets by dealing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, words = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    for _ in range(200):
        if words <= 1e-9 or not open_:
            break
        total = sum(w[s] for s in open_)
        excess = 0.0
        for s in list(open_):
            target[s] += words * w[s] / total
            if target[s] >= copies * sizes[s]:
                excess += target[s] - copies * sizes[s]
                target[s] = copies * sizes[s]
                open_.discard(s)
        words = excess
    return target


def test_source_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 25):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 5, 100, 5000, 90000]) for i in range(n)}
        df = spark.createDataFrame([(s, x) for s, x in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = _dealt(sizes)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_mix_near_targets_and_bounds(spark, small):
    a = sorted(tuple(r) for r in mixing.mix_documents(small).collect())
    b = sorted(tuple(r) for r in mixing.mix_documents(small.repartition(5)).collect())
    assert a == b
    total = {}
    for doc, size, _, target, taken, source in a:
        assert taken in (0, size, 2 * size)
        t = total.setdefault(source, [0, target, 0])
        t[0] += taken
        t[2] = max(t[2], size)
    assert all(abs(t - target) <= largest / 2 + 1 for t, target, largest in total.values())


def test_mix_edges(spark, edge, nothing):
    rows = mixing.mix_documents(edge.select("doc_id", "text", "source")).collect()
    assert len(rows) == edge.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_documents(nothing).count() == 0


def test_min_cost_flow_reroutes_and_repeats_last():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    flow = mixing.min_cost_flow([(ab, 100), (a, 50), (b, 10)], {"a": 50, "b": 110})
    assert flow == [{"a": 0, "b": 100}, {"a": 50}, {"b": 10}]  # no copy is repeated
    flow = mixing.min_cost_flow([(a, 50), (b, 10)], {"a": 70, "b": 100})
    assert flow == [{"a": 70}, {"b": 20}]


def test_mix_overlapping_sources(spark):
    rows = [(i, 10, ["a", "b"] if i < 50 else ["a"] if i < 80 else ["b"]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    targets = spark.createDataFrame([("a", 300.0), ("b", 700.0)], "source string, target double")
    out = mixing.mix(docs, targets).collect()
    assert sum(r["taken"] for r in out) == 1000 and all(r["taken"] == 10 for r in out)


def _score(a, b):
    """Plain Smith-Waterman."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_align_equals_plain_version():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(2, 7, rng.integers(1, 30)).astype(np.uint64), rng.integers(2, 7, rng.integers(1, 20)).astype(np.uint64)) for _ in range(300)]
    got = decontaminate.align([p for p, _ in pairs], [q for _, q in pairs])[:, 0]
    assert got.tolist() == [_score(q, p) for p, q in pairs]


def test_leaks_found_and_clean_left(spark):
    rng = random.Random(6)
    v = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(v) for _ in range(40))) for i in range(20)]
    docs = []
    for i in range(60):
        w = [rng.choice(v) for _ in range(300)]
        if i < 20:
            part = items[i][1].split()
            for _ in range(rng.choice([0, 3, 6])):
                part[rng.randrange(len(part))] = "edited"
            w[100:100] = part
        docs.append((i, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + items[:2] + [(99, "w1"), (98, None)], "item_id long, text string")
    for max_grams in (2_000_000, 100):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, max_grams=max_grams).collect()}
        assert got == {(i, i) for i in range(20)}
    left = decontaminate.without_leaks(d, b, max_grams=100)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(20, 60))


def test_leaks_that_keep_few_ngrams(spark):
    rng = random.Random(8)
    v = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(v) for _ in range(40))) for i in range(40)]
    docs = []
    for i, text in items:
        part = text.split()
        if i < 20:  # single words edited: 25 to 30 %
            for at in rng.sample(range(40), 10 + i % 3):
                part[at] = f"edited{at}"
        else:  # 45 % copied
            part = part[i % 22 :][:18]
        docs.append((i, " ".join([rng.choice(v) for _ in range(100)] + part + [rng.choice(v) for _ in range(100)])))
    # whole copies of an item next to a partial one: the partial copy holds none of the rarer n-grams
    docs += [(100 + i, items[30][1]) for i in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(40)} | {(100 + i, 30) for i in range(3)}
    for max_grams in (2_000_000, 100):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, max_grams=max_grams).collect()} == want
    assert decontaminate.without_leaks(d, b).count() == 0


def test_leaks_of_an_item_without_id(spark):
    text = "a test item of some ten words that stands in a text"
    docs = spark.createDataFrame([(1, "before it " + text + " and after"), (2, "nothing of it here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (-1, text), (None, None)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == [(1, -1), (1, None)]


def test_leaks_whole_table(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(small, bench).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got


def test_leaks_edges(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "some item that no document here holds")], "item_id long, text string")
    assert decontaminate.find_leaks(edge, bench).count() == 0
    assert decontaminate.without_leaks(edge, bench).count() == edge.count()
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(edge, bench.limit(0)).count() == 0
