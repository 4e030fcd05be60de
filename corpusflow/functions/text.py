"""Text Column expressions: cleaning, whitespace, word counts, word-border normalisation.

Every function is ``Column -> Column`` built from ``regexp_replace`` / ``split`` / ``trim`` so it
stays inside whole-stage codegen. The same regular expressions run unchanged in DuckDB (RE2),
which is how the oracle queries in ``plans.catalog`` mirror them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the semantics being reproduced) -------------------------------
# Whitespace as Python's str.isspace() defines it (29 code points). Spark's plain \s and
# DuckDB's \s both miss some of these, so one explicit class is used in both engines.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Unicode decimal digit (Python's \d on str).
DIGIT = r"\p{Nd}"
# Square brackets around nothing but numbers, with commas between them.
CITATION = r"\[" + WS + "*" + DIGIT + "+(?:" + WS + "*," + WS + "*" + DIGIT + "+)*" + WS + r"*\]"
# Round brackets around one number from 2000 to 2099.
YEAR = r"\(" + WS + "*20" + DIGIT + "{2}" + WS + r"*\)"
# Combining marks, then non-ASCII letters and non-ASCII numbers (see ``ascii_word_border``).
MARK = r"\p{M}"
NON_ASCII_WORD = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"
# ---------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Column | str) -> Column:
    """Every run of whitespace becomes one space."""
    return F.regexp_replace(_col(c), WS + "+", " ")


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (all 29 whitespace code points)."""
    return F.regexp_replace(F.regexp_replace(_col(c), "^" + WS + "+", ""), WS + "+$", "")


def clean_text(c: Column | str) -> Column:
    """Cleaning rule: drop numeric citations, then bracketed 20dd years, collapse whitespace,
    strip; null becomes the empty string."""
    t = F.coalesce(_col(c), F.lit(""))
    t = F.regexp_replace(t, CITATION, " ")
    t = F.regexp_replace(t, YEAR, " ")
    t = collapse_ws(t)
    # after collapsing, only single ASCII spaces can remain at the ends
    return F.trim(t)


def char_length(c: Column | str) -> Column:
    """Length in code points."""
    return F.length(_col(c))


def word_count(c: Column | str, cleaned: bool = True) -> Column:
    """Number of whitespace-separated words.

    On cleaned text (single spaces, stripped) this is ``size(split(t, ' '))``; the empty string
    has no words. For raw text the whitespace is collapsed first.
    """
    t = _col(c) if cleaned else F.trim(collapse_ws(c))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, " ")))


def ascii_word_border(c: Column | str) -> Column:
    """Rewrite text so that ASCII ``\\b`` gives Unicode word borders.

    Combining marks become ``.`` (not a word character, as in Unicode-aware engines) and any
    other non-ASCII letter or digit becomes ``_`` (a word character). ASCII characters, and
    therefore anything an ``[A-Za-z]`` pattern can capture, are unchanged.
    """
    t = F.regexp_replace(_col(c), MARK, ".")
    return F.regexp_replace(t, NON_ASCII_WORD, "_")


def title_words(c: Column | str) -> Column:
    """Title case: in every run of letters the first is upper-cased, the others lower-cased (so a new
    word also starts after a hyphen, an apostrophe or a digit)."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def word_tokens(c: Column | str, clean: bool = False) -> Column:
    """Lower-case word tokens.

    ``clean=False`` expects text that is already cleaned (split on the single space);
    ``clean=True`` applies the cleaning rule first (for raw text).
    """
    t = F.lower(clean_text(c) if clean else _col(c))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, " "))
