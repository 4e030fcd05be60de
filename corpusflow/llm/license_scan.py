"""License scan: exact set-similarity join of text blocks with license templates, in Spark SQL only.

A block is a line of the text, or any run of as many words as the longest template has, whatever lines they
stand on (notices are wrapped); its set is the block's distinct words. A block matches a template
when it holds at least ``threshold`` of the template's words (containment). A text holds what its blocks
hold, so texts are joined with the templates first, and only what passes is looked at block by block:

1. *Order.* Template words are ordered by the number of texts that hold them, rarest first (one count over the
   corpus, a row a template word).
2. *Filters*, on a text's template words in this order. A template of ``n`` words that needs ``k`` of them can only
   match a text that holds ``k`` template words at all (length), one of the template's first ``n - k + 1`` words
   (prefix), and enough words on either side of the first shared one (positional). What is left is verified by the size of
   the intersection.
3. *Blocks* of the texts that are left, for the templates that are left. A run starts at a word of the template; it
   can only match if ``k`` places of template words lie within its length, which two neighbouring entries of the list
   of places tell; then its distinct words are counted. Work is linear in the text.

Everything happens in the row: the templates are literals (at most ``MAX_TEMPLATE_WORDS`` words), no text and no block is
shuffled, and words are bound once a row, behind generators that the optimiser does not look through.

Defined cases: a null text counts as empty: no words, no places, no labels, score 0; repeated rows
each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import blank_if_null, let, read, with_columns

#: Fixed by the contract: words after lower-casing A-Z, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts words: the same rule turned round (splitting is cheaper than finding).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (label, template): one line each of common license notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
THRESHOLD = 0.9
MAX_TEMPLATE_WORDS = 20_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _words(c: Column) -> Column:
    """Words of a lower-cased text; an empty string may stand at either end."""
    return F.split(c, GAP)


def _n_words(w: Column) -> Column:
    """Number of words of a split text: an empty string may stand at either end."""
    ends = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    return (F.size(w) - ends).cast("long")


def base_scan(text: Column) -> Column:
    """Struct of n_base, first_word, last_word and base (labels) by the phrase rule."""
    t = blank_if_null(text)

    def phrase_at(w: Column, i: Column, phrase: str) -> Column:
        out = F.lit(True)
        for k, word in enumerate(phrase.split()):
            out = out & F.coalesce(F.get(w, i + k) == word, F.lit(False))
        return out

    def hits(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 1)
        one = lambda i: F.filter(
            F.array(*[F.when(phrase_at(w, i, p), F.struct(i.cast("long").alias("i"), F.lit(label).alias("label"))) for p, label in PHRASES.items()]),
            lambda x: x.isNotNull(),
        )
        return F.when(F.size(w) > 0, F.flatten(F.transform(places, one)))

    # the word list is only built where a phrase's last word occurs at all
    found = F.when(t.rlike("(?i)license"), let(F.filter(_words(ascii_lower(t)), lambda w: w != ""), hits))
    return let(
        F.coalesce(found, F.array().cast("array<struct<i:bigint,label:string>>")),
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_base"),
            F.array_min(h["i"]).alias("first_word"),
            F.array_max(h["i"]).alias("last_word"),
            F.array_sort(F.array_distinct(h["label"])).alias("base"),
        ),
    )


def _literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lowered(text: Column) -> Column:
    """The text with A-Z in lower case, as far as ASCII words go.

    ``lower`` is much faster than a translation by character. It also changes other letters, which no ASCII word has; the one
    character that it would turn into an ASCII letter by itself (the Kelvin sign) is replaced by another letter first.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00df")))


class Templates:
    """Templates with their words in corpus order, and what the filters need of them."""

    def __init__(self, templates, threshold: float):
        self.width = max((len(_python_words(body)) for _, body in templates), default=0)
        sets = [(label, sorted(set(_python_words(body)))) for label, body in templates]
        self.sets = [(label, s, -(-int(round(threshold * 10_000)) * len(s) // 10_000)) for label, s in sets if s]
        self.vocabulary = sorted({w for _, s, _ in self.sets for w in s})
        if not self.vocabulary or sum(len(s) for _, s, _ in self.sets) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates must have between 1 and {MAX_TEMPLATE_WORDS} words")
        if any(not w.isascii() for w in self.vocabulary):
            raise ValueError("template words must be ASCII")

    def ordered(self, docs: DataFrame) -> tuple[Column, Column]:
        """The vocabulary in corpus order, and an array of (label, words, prefix, need)."""
        held = F.array_intersect(_literal_array(self.vocabulary), _words(_lowered(blank_if_null(F.col("text")))))
        counts = {r["w"]: r["count"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()}  # a row a template word
        rank = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        rows = []
        for label, words, need in self.sets:
            words = sorted(words, key=rank.__getitem__)
            prefix = words[: len(words) - need + 1]
            rows.append(F.struct(F.lit(label).alias("label"), _literal_array(words).alias("words"), _literal_array(prefix).alias("prefix"), F.lit(need).alias("need")))
        return _literal_array(sorted(self.vocabulary, key=rank.__getitem__)), F.array(*rows)


def _may_match(t: Column, b: Column) -> Column:
    """Length, prefix and positional filter and the verification of one template on a block's ordered template words."""
    first = F.get(F.array_intersect(t["prefix"], b), F.lit(0))  # the rarest shared word
    left = F.least(F.size(t["words"]) - F.array_position(t["words"], first), F.size(b) - F.array_position(b, first))
    return (F.size(b) >= t["need"]) & first.isNotNull() & (left + 1 >= t["need"]) & (F.size(F.array_intersect(t["words"], b)) >= t["need"])


def _best_line(t: Column, lines: Column) -> Column:
    return F.array_max(F.transform(lines, lambda w: F.size(F.array_intersect(t["words"], w))))


def _best_run(t: Column, words: Column, width: int) -> Column:
    """Most distinct template words in any ``width`` consecutive words (0 if no run can match)."""

    def of_places(p: Column) -> Column:
        def run(x: Column, j: Column) -> Column:
            # the run from this place on can only match if the place of its need-th template word is near enough
            near = F.coalesce(F.get(p, j + t["need"] - 1)["i"] < x["i"] + width, F.lit(False))
            own = F.filter(F.slice(p, j + 1, F.lit(width)), lambda y: y["i"] < x["i"] + width)
            return F.when(near, F.size(F.array_distinct(F.transform(own, lambda y: y["w"])))).otherwise(0)

        return F.coalesce(F.array_max(F.transform(p, run)), F.lit(0))

    places = F.transform(words, lambda w, i: F.when(F.array_contains(t["words"], w), F.struct(i.alias("i"), w.alias("w"))))
    return let(F.filter(places, lambda x: x.isNotNull()), of_places)


def match_blocks(text: Column, found: Column, width: int) -> Column:
    """Of the templates that a text may match: (label, containment) of those that one of its blocks matches."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.filter(F.split(x, GAP), lambda w: w != ""))

    def of_lines(ls: Column) -> Column:
        def of_words(ws: Column) -> Column:
            def match(t: Column) -> Column:
                n = F.greatest(_best_line(t, ls), _best_run(t, ws, width))
                return let(n, lambda m: F.when(m >= t["need"], F.struct(t["label"].alias("label"), (m / F.size(t["words"])).alias("containment"))))

            return F.filter(F.transform(found, match), lambda x: x.isNotNull())

        return let(F.flatten(ls), of_words)

    return let(lines, of_lines)


def _joined(docs: DataFrame, known: Templates) -> DataFrame:
    """All columns of docs with ``n_words`` and ``_t``: the templates that the text as a whole matches."""
    by_rank, rows = known.ordered(docs)
    of_words = let(_words(_lowered(blank_if_null(F.col("text")))), lambda w: F.struct(_n_words(w).alias("n_words"), F.array_intersect(by_rank, w).alias("_b")))
    d = docs.select("*", F.inline(F.array(of_words)))
    least = min(need for _, _, need in known.sets)
    maybe = F.when(F.size("_b") >= least, F.filter(rows, lambda t: _may_match(t, F.col("_b")))).otherwise(F.filter(rows, lambda t: F.lit(False)))
    return d.select(*docs.columns, "n_words", F.explode(F.array(maybe)).alias("_t"))


def match_templates(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Lines that match a template: the columns of docs without the text, block (number of the line), label, containment."""
    others = [c for c in docs.columns if c != "text"]
    d = _joined(docs, Templates(templates, threshold)).where(F.size("_t") > 0)
    d = d.select(*others, "_t", F.posexplode(F.split(_lowered(blank_if_null(F.col("text"))), "\n")).alias("block", "_line"))
    d = d.select(*others, "block", F.explode(F.array(F.split("_line", GAP))).alias("_w"), "_t")
    d = d.select(*others, "block", "_w", F.explode("_t").alias("t"))
    d = d.select(*others, "block", F.col("t.label").alias("label"), "t.need", F.size("t.words").alias("of"), F.size(F.array_intersect("t.words", "_w")).alias("n"))
    return d.where("n >= need").select(*others, "block", "label", (F.col("n") / F.col("of")).alias("containment"))


def match_texts(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with ``n_words`` and ``matches``: (label, containment) of every template that a block, line or run, matches."""
    known = Templates(templates, threshold)
    none = F.array().cast("array<struct<label:string,containment:double>>")
    text = _lowered(blank_if_null(F.col("text")))
    matches = F.when(F.size("_t") > 0, match_blocks(text, F.col("_t"), known.width)).otherwise(none)
    return _joined(docs, known).select(*docs.columns, "n_words", F.explode(F.array(matches)).alias("matches"))


def _python_words(body: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", body.translate(str.maketrans(UPPER, LOWER)))


def scan(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: base places and labels, all labels, and the best containment as score."""
    d = with_columns(documents, {"doc_id": "long", "text": "string"})
    m = match_texts(d, templates, threshold)
    # a generator of one row: the scan of a text is evaluated once, not once for each of its fields
    b = m.select("doc_id", "n_words", "matches", F.inline(F.array(base_scan(F.col("text")))))
    labels = F.array_sort(F.array_union("base", F.col("matches")["label"]))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0)))
    return b.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    sets = [(t, label, sorted(set(_python_words(body)))) for t, (label, body) in enumerate(TEMPLATES)]
    templates = ", ".join(f"({t}, '{label}', {s!r})" for t, label, s in sets)
    width = max(len(_python_words(body)) for _, body in TEMPLATES)
    phrases = ", ".join(f"('{p}', {p.split()!r}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, doc_id, regexp_extract_all({low('t')}, '{WORD}') AS w FROM d),
p(phrase, ws, label) AS (VALUES {phrases}),
e AS (SELECT r, w, unnest(range(len(w))) AS i FROM x WHERE list_contains(w, 'license')),
h AS (SELECT e.r, e.i, p.label FROM e JOIN p ON e.w[e.i + 1] = p.ws[1] AND e.w[e.i + 1:e.i + len(p.ws)] = p.ws),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM h GROUP BY r),
k(template, label, s) AS (VALUES {templates}),
mk AS (SELECT x.r, x.w, k.label, k.s, CAST(ceil({THRESHOLD} * len(k.s) - 1e-9) AS BIGINT) AS need FROM x, k
       WHERE len(list_intersect(list_distinct(x.w), k.s)) >= ceil({THRESHOLD} * len(k.s) - 1e-9)),
rn AS (SELECT r, label, s, need, len(list_intersect(list_distinct(w[i:i + {width} - 1]), s)) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM mk)
       WHERE list_contains(s, w[i])),
ln AS (SELECT r, list_distinct(regexp_extract_all({low('l')}, '{WORD}')) AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
mt AS (SELECT r, k.label, len(list_intersect(lw, k.s)) / len(k.s) AS c FROM ln, k
       WHERE len(list_intersect(lw, k.s)) >= ceil({THRESHOLD} * len(k.s) - 1e-9)
       UNION ALL SELECT r, label, n / len(s) FROM rn WHERE n >= need),
m AS (SELECT r, list(DISTINCT label) AS more, max(c) AS containment FROM mt GROUP BY r)
SELECT x.doc_id, CAST(len(x.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(containment, 0.0)) AS DOUBLE) AS score
FROM x LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


SQL = _sql()
