"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression; the table of rules (measure, bound, from how many
words on it applies) is compiled into one array expression that names the rules a document breaks.
No user function runs, nothing is shuffled, and a document is read once.

Defined cases: a null or blank text has no words and fails the base rule; columns beside ``doc_id``
and ``text`` are ignored, whatever their names; repeated rows each give a row; an empty table gives
an empty result; long texts need memory for one array of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import SPACE_CLASS, WORD, blank_if_null, let, read, with_columns

#: Frequent function words of the four languages, the stop words of the rule below.
STOP_WORDS = (
    "the of and to in a is that it for as with was on be by this are from an or "
    "le la les de des et un une du en que qui est dans pour au aux il elle par sur "
    "der die das und ein eine zu mit den ist von im auf als auch nicht für sie es "
    "el los las del y por con para se su una no al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if its measure is below ``least`` or above ``most``; documents of fewer than ``from_words`` words are exempt."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The production table. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("too_short", "n_words", least=10),
    Rule("repeated_windows", "repeat_ratio", most=0.2),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("shouting", "bang_ratio", most=0.3),
    Rule("word_length", "mean_word_length", least=2.0, most=20.0, from_words=10),
    Rule("few_stop_words", "stop_ratio", least=0.005, from_words=100),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5, from_words=50),
    Rule("bullets", "bullet_line_ratio", most=0.9, from_words=50),
)


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Number of words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. A text whose windows all differ
    (a hash set tells) costs no sort; else the windows are sorted with their places, neighbours
    with equal hashes give the places, and each place covers up to ``width`` words before the next.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(places, j + 1) - p, F.lit(width)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def places(s: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            before = F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False))
            after = F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False))
            return F.when(before | after, x["i"])

        return F.sort_array(F.filter(F.transform(s, twice), lambda i: i.isNotNull()))

    def of_windows(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, lambda s: let(places(s), covered)))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        )
        return F.when(F.size(h) <= width, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(text: Column) -> dict[str, Column]:
    """The counts every rule is made of, as one struct's fields (null text: as an empty one)."""
    t = blank_if_null(text)
    words = F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    from_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
        ),
    )
    from_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return {
        "of_words": from_words,
        "of_lines": from_lines,
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE_CLASS))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_bangs": F.regexp_count(t, F.lit(r"!!+")).cast("long"),
        # only \n ends a line, as in the split above
        "n_bullets": F.regexp_count(t, F.lit(r"(?md)^[\x20\x09]*[-*•]\x20")).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...], value: dict[str, Column]) -> Column:
    """The table as one expression: the sorted names of the rules a row breaks."""

    def broken(r: Rule) -> Column:
        v = value[r.measure]
        out = F.lit(False)
        if r.least is not None:
            out = out | (v < F.lit(r.least))
        if r.most is not None:
            out = out | (v > F.lit(r.most))
        return F.when((value["n_words"] >= r.from_words) & out, F.lit(r.name))

    return F.array_sort(F.filter(F.array(*[broken(r) for r in rules]), lambda x: x.isNotNull()))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: its counts, the rules it breaks, and whether it is kept."""
    d = with_columns(docs, {"doc_id": "long", "text": "string"})
    m = d.select("doc_id", *[c.alias(k) for k, c in measures(F.col("text")).items()]).select(
        "doc_id", "of_words.n_words", "word_chars", "n_symbols", "of_lines.n_dup_lines", "of_words.n_repeat_words",
        "of_lines.n_lines", "n_bangs", "of_words.n_stop", "n_bullets",
    )
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    per_line = F.greatest(F.col("n_lines"), F.lit(1))
    value = {
        "n_words": F.col("n_words"),
        "repeat_ratio": F.col("n_repeat_words") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "bang_ratio": F.col("n_bangs") / per_word,
        "mean_word_length": F.col("word_chars") / per_word,
        "stop_ratio": F.col("n_stop") / per_word,
        "dup_line_ratio": F.col("n_dup_lines") / per_line,
        "bullet_line_ratio": F.col("n_bullets") / per_line,
    }
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), compile_rules(rules, value).alias("broken"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents")).drop("broken")


_WS = r"[\x20\x09-\x0D]"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(x) AS word, generate_subscripts(x, 1) AS i
      FROM (SELECT r, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS x FROM d)),
g AS (SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram,
             lead(word, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE whole) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.r,
        len(regexp_extract_all(t, '{WORD}')) AS n_words,
        length(regexp_replace(t, '{_WS}', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(ln.n_dup, 0) AS n_dup_lines, coalesce(ln.n_lines, 0) AS n_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        len(regexp_extract_all(t, '!!+')) AS n_bangs,
        len(list_filter(regexp_split_to_array(t, '{_WS}+'),
            lambda x: lower(x) IN ({", ".join(repr(w) for w in sorted(set(STOP_WORDS)))}))) AS n_stop,
        len(regexp_extract_all(t, '(?m)^[\\x20\\x09]*[-*•]\\x20')) AS n_bullets
      FROM d LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         n_symbols / greatest(n_words, 1) > 0.1 OR n_bangs / greatest(n_words, 1) > 0.3
         OR (n_words >= 10 AND (word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 20.0))
         OR (n_words >= 100 AND n_stop / greatest(n_words, 1) < 0.005)
         OR (n_words >= 50 AND n_dup_lines / greatest(n_lines, 1) > 0.5)
         OR (n_words >= 50 AND n_bullets / greatest(n_lines, 1) > 0.9)) AS kept
FROM b
"""
