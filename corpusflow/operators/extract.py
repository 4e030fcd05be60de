"""Term extraction: dictionary hits (substring) and ``<word> <head>`` pattern hits.

``extract_terms`` is a Column expression (no shuffle): lower-case the raw text once, keep the
dictionary terms it contains, add every non-overlapping ``\\b([A-Za-z]+ <head>)\\b`` match, title-case,
de-duplicate and sort. ``dictionary_join`` is the same containment test for a dictionary held in a
table, with the join strategy chosen from the dictionary's checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, ascii_word_border, strip_ws, title_words
from ..functions.vectors import let
from ..session import materialize

# one character that is not whitespace (the complement of WS)
NOT_WS = "[^" + WS[1:]

# --- fixed values: the default disease dictionary and head noun -----------------------------
DEFAULT_TERMS = [
    "lung cancer", "breast cancer", "colon cancer", "liver cancer", "cervical cancer",
    "prostate cancer", "skin cancer", "thyroid cancer", "leukemia", "melanoma",
    "pancreatic cancer", "brain tumor", "gastric cancer", "ovarian cancer",
    "kidney cancer", "stomach cancer", "esophageal cancer",
]
DEFAULT_HEAD = "cancer"
# ---------------------------------------------------------------------------------------------

# dictionaries above this many terms (or bytes) are not broadcast as one piece
MAX_BROADCAST_TERMS = 200_000
MAX_BROADCAST_BYTES = 64 << 20

_REGEX_SPECIAL = set(r".^$*+?()[]{}|\\")


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in s)


def head_pattern(head: str = DEFAULT_HEAD) -> str:
    """``\\b([A-Za-z]+ <head>)\\b`` – one ASCII word, one literal space, the head noun."""
    return r"\b([A-Za-z]+ " + _quote(head) + r")\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dictionary_hits_low(low: Column, terms: list[str], title: bool) -> Column:
    arr = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    hits = F.filter(arr, lambda t: F.contains(low, t))
    return F.transform(hits, title_words) if title else hits


def _pattern_hits_low(low: Column, head: str, stopwords: list[str] | None, title: bool) -> Column:
    s = ascii_word_border(low)
    hits = F.regexp_extract_all(s, F.lit(head_pattern(head)), 1)
    if stopwords:
        stop = F.array(*[F.lit(w.lower()) for w in stopwords])
        hits = F.filter(hits, lambda m: ~F.array_contains(stop, F.substring_index(m, " ", 1)))
    hits = F.transform(hits, title_words) if title else hits
    # a match needs " <head>" in the text (normalisation keeps ASCII as is): skip the regex work
    # for texts without it
    return F.when(F.contains(low, F.lit(" " + head.lower())), hits).otherwise(F.array().cast("array<string>"))


def dictionary_hits(text: Column | str, terms: list[str] = DEFAULT_TERMS, title: bool = True) -> Column:
    """Terms (lower case) contained in ``lower(text)`` as plain substrings, dictionary order."""
    # lower-case the text once per row, not once per term
    return let(F.lower(_col(text)), lambda low: _dictionary_hits_low(low, terms, title))


def pattern_hits(text: Column | str, head: str = DEFAULT_HEAD, stopwords: list[str] | None = None,
                 title: bool = True) -> Column:
    """Every non-overlapping ``<word> <head>`` in the lower-cased raw text.

    Matching runs on ``ascii_word_border(lower(text))`` so that ``\\b`` is the Unicode word border
    in Java's and RE2's regex engines alike. ``stopwords`` drops first words such as ``of``.
    """
    return let(F.lower(_col(text)), lambda low: _pattern_hits_low(low, head, stopwords, title))


def extract_terms(text: Column | str, terms: list[str] = DEFAULT_TERMS, head: str | None = DEFAULT_HEAD,
                  stopwords: list[str] | None = None) -> Column:
    """Sorted distinct title-cased names: dictionary hits united with pattern hits."""

    def names(low: Column) -> Column:
        parts = [_dictionary_hits_low(low, terms, True)]
        if head:
            parts.append(_pattern_hits_low(low, head, stopwords, True))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    return let(F.lower(_col(text)), names)


def term_counts(df: DataFrame, names_col: str = "extracted", name: str = "name") -> DataFrame:
    """Documents per extracted name (explode + partial aggregation)."""
    return df.select(F.explode(names_col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n_docs"))


def dictionary_join(docs: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term",
                    mode: str = "substring", max_terms: int = MAX_BROADCAST_TERMS,
                    max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Rows ``docs x terms`` where the lower-cased text contains the (lower-case) term.

    ``mode="substring"`` keeps the plain-substring rule as an equi-join on a short key. A term has a key
    for each of its parts (see ``_key_options``); of these the one that the fewest texts hold is looked up, by a count of the
    dictionary's keys over all texts, and a term with a key that no text holds is out. A text's candidates
    are its distinct tokens' first and last letters (pieces of its tokens, if some term has no inner
    whitespace). Every term has one key and candidates are distinct per row, so a pair is found once; what shares
    a key is verified by containment of the whole term. Work is linear in the text; dictionaries above the
    checked broadcast size are cut into hash shards that each fit (exact at any size).

    ``mode="words"`` matches whole word sequences only: word n-grams of the text (n up to the
    longest term's word count) equi-join the dictionary, broadcast when it fits, else a shuffle
    hash join (hot n-grams are split by adaptive skew handling).
    """
    if mode not in ("substring", "words"):
        raise ValueError("mode must be 'substring' or 'words'")
    t = terms.select(F.lower(F.col(term_col)).alias(term_col)).where(F.length(term_col) > 0).distinct()
    if mode == "words":
        size = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(term_col)), F.lit(0)).alias("b"),
                     F.max(F.size(F.split(term_col, " "))).alias("max_words")).first()
        fits = int(size["n"]) <= max_terms and int(size["b"]) <= max_bytes
        return _ngram_join(docs, t, text_col, term_col, int(size["max_words"] or 1), fits)
    low, key = "_cf_low", "_cf_key"
    options = materialize(_key_options(t, term_col, key), "dictionary_keys")
    d = docs.withColumn(low, F.lower(F.col(text_col)))
    shapes = sorted((r[0], r[1]) for r in options.select("kind", "letters").distinct().collect())  # a few dozen at most
    if not shapes:
        return d.withColumn(term_col, F.lit(None).cast("string")).where(F.lit(False)).drop(low)
    cand = d.withColumn(key, F.explode(_candidate_keys(F.col(low), shapes)))
    if options.groupBy(term_col).count().where("count > 1").limit(1).count():
        keyed = _rarest_keys(cand.select(key), options, term_col, key, max_terms, max_bytes)
    else:
        keyed = options  # one key a term: nothing to choose
    out = None
    for part in _shards(keyed.select(key, term_col), term_col, max_terms, max_bytes):
        j = cand.join(F.broadcast(part), key).where(F.contains(F.col(low), F.col(term_col)))
        out = j if out is None else out.unionByName(j)
    return out.drop(key, low)


# letters of a term that its key takes, from the start or the end of a part
KEY_LETTERS = 8


def _key_options(t: DataFrame, term_col: str, key: str) -> DataFrame:
    """``term, key, kind, letters``: the keys a term may be looked up by; a text with the term holds each of them.

    A term without inner whitespace lies inside one token: its first letters, wherever they stand in a token. With
    inner whitespace each part but the first begins a token (its first letters begin one) and each part but the last
    ends one. Whitespace alone is its own key, a piece of a whitespace run.
    """
    core = strip_ws(F.col(term_col))
    parts = F.when(F.length(core) > 0, F.split(core, WS + "+")).otherwise(F.array().cast("array<string>"))
    n = F.size(parts)

    def option(x: Column, kind: str, letters: Column) -> Column:
        return F.struct(x.alias(key), F.lit(kind).alias("kind"), letters.alias("letters"))

    def of(p: Column, i: Column) -> Column:
        q = F.least(F.length(p), F.lit(KEY_LETTERS))
        first, last = p.substr(F.lit(1), q), p.substr(F.length(p) - q + 1, q)
        return F.array_compact(F.array(
            F.when(n == 1, option(first, "inside", q)), F.when(i > 0, option(first, "begin", q)), F.when((n > 1) & (i < n - 1), option(last, "end", q))))

    blank = F.array(option(F.col(term_col), "blank", F.length(term_col)))
    each = F.when(n == 0, blank).otherwise(F.flatten(F.transform(parts, of)))
    return t.select(term_col, F.explode(each).alias("x")).select(term_col, "x.*").distinct()


def _shards(keyed: DataFrame, term_col: str, max_terms: int, max_bytes: int) -> list[DataFrame]:
    """The table in parts of checked size (rows and bytes), by a hash of the term."""
    names = [F.octet_length(c) for c in keyed.columns]
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(names, F.lit(16))), F.lit(0)).alias("b")).first()
    n = max(1, -(-int(size["n"]) // max_terms), -(-int(size["b"]) // max_bytes))
    return [keyed] if n == 1 else [keyed.where(F.pmod(F.xxhash64(term_col), F.lit(n)) == i) for i in range(n)]


def _rarest_keys(found: DataFrame, options: DataFrame, term_col: str, key: str, max_terms: int, max_bytes: int) -> DataFrame:
    """``term, key``: of each term the key that the fewest texts hold. A term with a key that no text holds stands in none and goes.

    Only the dictionary's keys are counted, by partial sums.
    """
    counts = None
    for part in _shards(options.select(key).distinct(), key, max_terms, max_bytes):
        c = found.join(F.broadcast(part), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    counts = materialize(counts, "dictionary_counts")  # at most one row a key of the dictionary
    ranked = options.join(counts, key, "left").groupBy(term_col).agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col(key))).alias("x"))
    return materialize(ranked.where(F.col("x.n") > 0).select(term_col, F.col(f"x.{key}").alias(key)), "dictionary_rarest")


def _pieces_of_runs(runs: Column, sizes: list[int]) -> Column:
    """All substrings of the given lengths of all runs."""

    def pieces(x: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(x) - F.lit(n - 1), F.lit(1)))
        return F.when(F.length(x) >= n, F.transform(starts, lambda i: x.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    long_enough = F.filter(runs, lambda x: F.length(x) >= min(sizes))
    return F.flatten(F.transform(long_enough, lambda x: F.flatten(F.array(*[pieces(x, n) for n in sizes]))))


def _candidate_keys(low: Column, shapes: list[tuple[str, int]]) -> Column:
    """Distinct keys of the given shapes that occur in a lower-cased text."""
    sizes = {kind: [n for k, n in shapes if k == kind] for kind in ("inside", "begin", "end", "blank")}

    def ends(t: Column) -> Column:
        first = [F.when(F.length(t) >= n, t.substr(F.lit(1), F.lit(n))) for n in sizes["begin"]]
        last = [F.when(F.length(t) >= n, F.right(t, F.lit(n))) for n in sizes["end"]]
        return F.array(*first, *last)

    def of_tokens(tokens: Column) -> Column:
        parts = []
        if sizes["begin"] or sizes["end"]:
            parts.append(F.filter(F.flatten(F.transform(tokens, ends)), lambda x: x.isNotNull()))
        if sizes["inside"]:
            parts.append(_pieces_of_runs(tokens, sizes["inside"]))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    parts = []
    if sizes["begin"] or sizes["end"] or sizes["inside"]:
        parts.append(let(F.array_distinct(F.split(low, WS + "+")), of_tokens))
    if sizes["blank"]:
        parts.append(_pieces_of_runs(F.array_distinct(F.split(low, NOT_WS + "+")), sizes["blank"]))
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def _ngram_join(docs: DataFrame, terms: DataFrame, text_col: str, term_col: str, max_n: int,
                broadcast_ok: bool) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text_col)), WS + "+", " ")), " ")
    w = "_cf_words"
    d = docs.withColumn(w, words)

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.when(F.size(w) >= n, F.array_join(F.slice(w, i, n), " ")))

    grams = [grams_of(n) for n in range(1, max_n + 1)]
    g = "_cf_gram"
    exploded = d.withColumn(g, F.explode(F.array_distinct(F.filter(F.flatten(F.array(*grams)), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0))))
    side = F.broadcast(terms) if broadcast_ok else terms
    return exploded.join(side, exploded[g] == side[term_col]).drop(g, w)
