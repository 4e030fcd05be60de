"""Registered queries: each runs the library on the driver tables, next to its DuckDB SQL twin.

Every query reads whole tables (``documents``, ``labels``, ``embeddings``, ``conversations``) and
returns a DataFrame whose column names equal those of its SQL. Doubles are rounded to 6 decimals on
both sides; arrays are either exploded to rows or joined to strings in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize, spread
from ..functions import vectors as vx
from ..operators.evaluate import class_report, confusion_long, confusion_wide, evaluate
from ..operators.extract import dictionary_join, extract_terms, term_counts
from ..operators.labels import label_dimension, with_label_id, with_label_name
from ..operators.split import seeded_rank, split_exact
from ..operators.stats import corpus_stats, label_counts
from .prepare import clean_rows, dropped_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SEED = 42
FLAGSHIP = "enriched_predictions"
TRAIN, VAL = 0.8, 0.1


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


# text tables: their per-row work is CPU-bound, so a scan with too few splits is spread out
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows and name in TEXT_TABLES else df


# ---------------------------------------------------------------- SQL fragments (DuckDB)
def sql_clean(e: str) -> str:
    t = f"coalesce({e}, '')"
    t = f"regexp_replace({t}, '{tx.CITATION}', ' ', 'g')"
    t = f"regexp_replace({t}, '{tx.YEAR}', ' ', 'g')"
    t = f"regexp_replace({t}, '{tx.WS}+', ' ', 'g')"
    return f"trim({t})"


def sql_words(e: str) -> str:
    return f"(CASE WHEN length({e}) = 0 THEN 0 ELSE len(string_split({e}, ' ')) END)"


def sql_norm(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '{tx.MARK}', '.', 'g'), '{tx.NON_ASCII_WORD}', '_', 'g')"


def sql_title(e: str) -> str:
    runs = f"regexp_extract_all({e}, '\\p{{L}}+|\\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def sql_r6(e: str) -> str:
    return f"round({e}, 6)"


def sql_key(e: str, seed: int = SEED) -> str:
    return f"md5('{seed}:' || CAST({e} AS VARCHAR))"


def sql_split(src: str, id_col: str, tr: float = TRAIN, vr: float = VAL, seed: int = SEED) -> str:
    """SELECT of ``src`` plus ``split`` by the seeded order (global row_number: fine for the oracle)."""
    return f"""
    (SELECT * EXCLUDE (_pos, _n), CASE WHEN _pos < floor(_n * {tr}::DOUBLE) THEN 'train'
             WHEN _pos < floor(_n * {tr}::DOUBLE) + floor(_n * {vr}::DOUBLE) THEN 'val' ELSE 'test' END AS split
     FROM (SELECT *, row_number() OVER (ORDER BY {sql_key(id_col, seed)}, {id_col}) - 1 AS _pos,
                  count(*) OVER () AS _n FROM {src}))"""


# documents cleaned, non-empty, label = language, seeded split
SQL_DOCS_PREPARED = sql_split(
    f"(SELECT doc_id, lang AS label, {sql_clean('text')} AS text FROM documents WHERE length({sql_clean('text')}) > 0)",
    "doc_id",
)


def docs_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows without their text: only ids, labels and lengths of the cleaned text are written."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    rows = clean_rows(d).select("doc_id", "label", F.length("text").alias("n_chars"), tx.word_count("text").alias("n_words"))
    return split_exact(materialize(rows, "cleaned"), "doc_id", TRAIN, VAL, SEED)


def prepared_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats(docs_prepared(spark, sf_dir), chars_col="n_chars", words_col="n_words")


# ---------------------------------------------------------------- cleaning (PRJ1, FN1-4, FLT1-2)
# The driver's documents hold no citation, year or Unicode space, so the query appends some.
NOISE_SQL = "text || ' [' || CAST(doc_id % 7 AS VARCHAR) || ', 2] (20' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ')' || chr(160) || chr(8201) || 'end ' || chr(12288)"


def _noisy(d: DataFrame) -> Column:
    return F.concat(
        F.col("text"), F.lit(" ["), (F.col("doc_id") % 7).cast("string"), F.lit(", 2] (20"),
        F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(")\u00a0\u2009end \u3000"),
    )


@register("clean_text", f"""
SELECT doc_id, t AS text_clean, length(t) AS n_chars_clean, {sql_words('t')} AS n_words
FROM (SELECT doc_id, {sql_clean(NOISE_SQL)} AS t FROM documents) WHERE length(t) > 0""")
def q_clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = clean_rows(d.select("doc_id", _noisy(d).alias("text_clean")), "text_clean")
    return c.select("doc_id", "text_clean", F.length("text_clean").cast("long").alias("n_chars_clean"),
                    tx.word_count("text_clean").cast("long").alias("n_words"))


@register("clean_dropped", f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE length({sql_clean('text')}) > 0) AS rows_after,
       count(*) FILTER (WHERE length({sql_clean('text')}) = 0) AS rows_dropped
FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)""")
def q_clean_dropped(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("text").unionByName(
        table(spark, sf_dir, "conversations").select("text"))
    return dropped_count(t)


# ---------------------------------------------------------------- labels (AGG8, SRT2, PRJ2, PRJ9, JN1-2)
@register("label_index", """
SELECT doc_id, lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id FROM documents""")
def q_label_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    return with_label_id(d, "label").select("doc_id", "label", "label_id")


@register("label_decode", """
WITH dim AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
             FROM (SELECT DISTINCT lang AS label FROM documents))
SELECT d.doc_id, CAST(d.doc_id % 4 AS INTEGER) AS pred_id, dim.label AS pred_label
FROM documents d LEFT JOIN dim ON dim.label_id = d.doc_id % 4""")
def q_label_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    dim = label_dimension(d.select(F.col("lang").alias("label")))
    p = d.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("pred_id"))
    return with_label_name(p, "pred_id", dim, name_col="pred_label").select("doc_id", "pred_id", "pred_label")


# ---------------------------------------------------------------- seeded order and split (SRT3-4, WIN1, FN16)
@register("seeded_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql_key('doc_id')}, doc_id) - 1 AS pos FROM documents""")
def q_seeded_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return seeded_rank(d, "doc_id", SEED).select("doc_id", "pos")


@register("split_exact", f"SELECT doc_id, split FROM {SQL_DOCS_PREPARED}")
def q_split_exact(spark, sf_dir):
    return docs_prepared(spark, sf_dir).select("doc_id", "split")


@register("split_sizes", f"SELECT split, count(*) AS n FROM {SQL_DOCS_PREPARED} GROUP BY split")
def q_split_sizes(spark, sf_dir):
    return docs_prepared(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- statistics (AGG1-7, AGG21, SRT7, FN9-10)
@register("corpus_stats", f"""
SELECT CASE WHEN grouping(split) = 1 THEN 'global' ELSE split END AS scope, count(*) AS num_samples,
       round(avg(length(text)), 6) AS avg_len_chars, round(avg({sql_words('text')}), 6) AS avg_len_words,
       CAST(min({sql_words('text')}) AS INTEGER) AS min_len_words, CAST(max({sql_words('text')}) AS INTEGER) AS max_len_words,
       count(DISTINCT label) AS num_labels
FROM {SQL_DOCS_PREPARED} GROUP BY GROUPING SETS ((split), ())""")
def q_corpus_stats(spark, sf_dir):
    s = prepared_stats(spark, sf_dir)
    return s.select(
        "scope", "num_samples", F.round("avg_len_chars", 6).alias("avg_len_chars"),
        F.round("avg_len_words", 6).alias("avg_len_words"), "min_len_words", "max_len_words",
        F.size(F.map_keys("label_counts")).cast("long").alias("num_labels"),
    )


@register("label_counts", f"""
SELECT CASE WHEN grouping(split) = 1 THEN 'global' ELSE split END AS scope, label, count(*) AS n
FROM {SQL_DOCS_PREPARED} GROUP BY GROUPING SETS ((split, label), (label))""")
def q_label_counts(spark, sf_dir):
    return label_counts(docs_prepared(spark, sf_dir))


@register("label_counts_ranked", f"""
SELECT scope, label, n, CAST(row_number() OVER (PARTITION BY scope ORDER BY n DESC, label) AS INTEGER) AS rank_in_scope
FROM (SELECT CASE WHEN grouping(split) = 1 THEN 'global' ELSE split END AS scope, label, count(*) AS n
      FROM {SQL_DOCS_PREPARED} GROUP BY GROUPING SETS ((split, label), (label)))""")
def q_label_counts_ranked(spark, sf_dir):
    """The ``label_counts`` map of ``corpus_stats`` read back in its order (most frequent first)."""
    s = prepared_stats(spark, sf_dir)
    e = s.select("scope", F.posexplode(F.map_entries("label_counts")).alias("p", "e"))
    return e.select("scope", F.col("e.key").alias("label"), F.col("e.value").alias("n"),
                    (F.col("p") + 1).cast("int").alias("rank_in_scope"))


# ---------------------------------------------------------------- extraction (EXT1-2, JN4, SET2, FN5-8, AGG20, SRT6)
# The driver's documents never contain "cancer", so these queries pass their own terms and head noun.
QUERY_TERMS = ["in the", "of the", "tion"]
QUERY_HEAD = "the"
SQL_QUERY_TERMS = "(VALUES " + ", ".join(f"('{t}')" for t in QUERY_TERMS) + ") v(term)"
SQL_HITS = f"""
(SELECT DISTINCT doc_id, {sql_title('m')} AS name FROM (
   SELECT doc_id, term AS m FROM documents, {SQL_QUERY_TERMS} WHERE contains(lower(text), term)
   UNION ALL
   SELECT doc_id, unnest(regexp_extract_all({sql_norm('lower(text)')}, '\\b([A-Za-z]+ {QUERY_HEAD})\\b', 1)) AS m
   FROM documents))"""


def docs_extracted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", extract_terms("text", QUERY_TERMS, QUERY_HEAD).alias("extracted"))


@register("dict_match", f"SELECT doc_id, term FROM documents, {SQL_QUERY_TERMS} WHERE contains(lower(text), term)")
def q_dict_match(spark, sf_dir):
    from ..operators.extract import dictionary_hits

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(dictionary_hits("text", QUERY_TERMS, title=False)).alias("term"))


# a table-sized dictionary derived from the data: long words of the benchmark passages
SQL_BENCH_TERMS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}', 0)) AS term FROM benchmark)"


def bench_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), 0)).alias("term")).distinct()


@register("dict_match_join", f"""
SELECT d.doc_id, t.term FROM documents d JOIN {SQL_BENCH_TERMS} t ON contains(lower(d.text), t.term)""")
def q_dict_match_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary_join(d, bench_terms(spark, sf_dir)).select("doc_id", "term")


# a table-sized dictionary of phrases: pairs of long words as they follow each other in the passages
SQL_BENCH_PHRASES = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,} [a-z]{6,}', 0)) AS term FROM benchmark)"


def bench_phrases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,} [a-z]{6,}"), 0)).alias("term")).distinct()


@register("dict_match_phrases", f"""
SELECT d.doc_id, t.term FROM documents d JOIN {SQL_BENCH_PHRASES} t ON contains(lower(d.text), t.term)""")
def q_dict_match_phrases(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary_join(d, bench_phrases(spark, sf_dir)).select("doc_id", "term")


@register("dict_match_words", f"""
SELECT DISTINCT d.doc_id, t.term FROM
  (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '{tx.WS}+', ' ', 'g')), ' ')) AS w FROM documents) d
  JOIN {SQL_BENCH_TERMS} t ON d.w = t.term""")
def q_dict_match_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary_join(d, bench_terms(spark, sf_dir), mode="words").select("doc_id", "term")


@register("term_extract", f"SELECT doc_id, name FROM {SQL_HITS}")
def q_term_extract(spark, sf_dir):
    return docs_extracted(spark, sf_dir).select("doc_id", F.explode("extracted").alias("name"))


@register("term_extract_sorted", f"""
SELECT doc_id, string_agg(name, '|' ORDER BY name) AS names, CAST(count(*) AS INTEGER) AS n_names
FROM {SQL_HITS} GROUP BY doc_id""")
def q_term_extract_sorted(spark, sf_dir):
    e = docs_extracted(spark, sf_dir).where(F.size("extracted") > 0)
    return e.select("doc_id", F.array_join("extracted", "|").alias("names"), F.size("extracted").alias("n_names"))


@register("term_counts", f"SELECT name, count(*) AS n_docs FROM {SQL_HITS} GROUP BY name")
def q_term_counts(spark, sf_dir):
    return term_counts(docs_extracted(spark, sf_dir))


# ---------------------------------------------------------------- vectors (FN11-12, LIM2)
SQL_SOFTMAX = """
(SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM
 (SELECT vec_id, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM
  (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k,
          CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)))"""


def _emb_probs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # the whole vector is read as one row of logits
    return e.select("vec_id", vx.softmax("embedding").alias("p"))


@register("softmax_argmax", f"""
SELECT vec_id, CAST(arg_max(k, p) AS INTEGER) AS pred_id, round(max(p), 6) AS p_max, round(sum(p), 6) AS p_sum
FROM {SQL_SOFTMAX} GROUP BY vec_id""")
def q_softmax_argmax(spark, sf_dir):
    p = _emb_probs(spark, sf_dir)
    return p.select("vec_id", vx.argmax("p").alias("pred_id"), F.round(F.array_max("p"), 6).alias("p_max"),
                    F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("p_sum"))


@register("confidence_map", f"SELECT vec_id, 'c' || CAST(k AS VARCHAR) AS class, round(p, 6) AS prob FROM {SQL_SOFTMAX}")
def q_confidence_map(spark, sf_dir):
    p = _emb_probs(spark, sf_dir)
    names = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.concat(F.lit("c"), i.cast("string")))
    m = p.select("vec_id", vx.confidence_map(names, "p").alias("m"))
    return m.select("vec_id", F.explode("m").alias("class", "prob")).withColumn("prob", F.round("prob", 6))


# ---------------------------------------------------------------- evaluation (AGG9-16, JN3, FN18, SRT5, WIN3)
RULE_K = 2000
SQL_RULE = f"""
(SELECT l.doc_id, l.quality AS label_id, CAST(d.n_chars > {{k}} AS INTEGER) AS pred_id
 FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def rule_predictions(spark, sf_dir, k: int = RULE_K) -> DataFrame:
    """A fixed rule scorer (long documents are predicted ``quality = 1``), joined to the truth by key."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id"))
    d = table(spark, sf_dir, "documents", spread_rows=False).select("doc_id", "n_chars")
    return lab.join(d, "doc_id").select("doc_id", "label_id", (F.col("n_chars") > k).cast("int").alias("pred_id"))


def _metric_cols(m: DataFrame, extra: list[str] | None = None) -> DataFrame:
    cols = [F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    return m.select(*(extra or []), *cols, "tn", "fp", "fn", "tp", "support")


def sql_metrics(src: str, group: str = "", pos: int = 1, rounded: bool = True) -> str:
    g = f"{group}, " if group else ""
    tp = f"count(*) FILTER (WHERE label_id = {pos} AND pred_id = {pos})"
    fp = f"count(*) FILTER (WHERE label_id <> {pos} AND pred_id = {pos})"
    fn = f"count(*) FILTER (WHERE label_id = {pos} AND pred_id <> {pos})"

    def ratio(a, b):
        r = f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
        return f"round({r}, 6)" if rounded else r

    return f"""SELECT {g}{ratio('count(*) FILTER (WHERE label_id = pred_id)', 'count(*)')} AS accuracy,
       {ratio(tp, f'{tp} + {fp}')} AS precision, {ratio(tp, f'{tp} + {fn}')} AS recall,
       {ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1,
       count(*) FILTER (WHERE label_id = 0 AND pred_id = 0) AS tn, {fp} AS fp, {fn} AS fn, {tp} AS tp,
       count(*) AS support FROM {src} {'GROUP BY ' + group if group else ''}"""


@register("rule_metrics", sql_metrics(SQL_RULE.format(k=RULE_K)))
def q_rule_metrics(spark, sf_dir):
    return _metric_cols(evaluate(rule_predictions(spark, sf_dir), classes=[0, 1]))


SQL_CONF_LONG = f"""
SELECT t.c AS true_id, p.c AS pred_id, count(r.doc_id) AS n
FROM (VALUES (0), (1)) t(c) JOIN (VALUES (0), (1)) p(c) ON true
LEFT JOIN {SQL_RULE.format(k=RULE_K)} r ON r.label_id = t.c AND r.pred_id = p.c
GROUP BY t.c, p.c"""


@register("confusion_long", SQL_CONF_LONG)
def q_confusion_long(spark, sf_dir):
    return confusion_long(rule_predictions(spark, sf_dir))


@register("confusion_wide", f"""
SELECT true_id, sum(n) FILTER (WHERE pred_id = 0)::BIGINT AS pred_0, sum(n) FILTER (WHERE pred_id = 1)::BIGINT AS pred_1
FROM ({SQL_CONF_LONG}) GROUP BY true_id""")
def q_confusion_wide(spark, sf_dir):
    long = confusion_long(rule_predictions(spark, sf_dir))
    return confusion_wide(long, [0, 1])


@register("class_report", f"""
WITH c AS ({SQL_CONF_LONG}),
per AS (SELECT r.cls, r.support, r.tp, p.pred FROM
          (SELECT true_id AS cls, sum(n) AS support, sum(n) FILTER (WHERE true_id = pred_id) AS tp FROM c GROUP BY true_id) r
          JOIN (SELECT pred_id AS cls, sum(n) AS pred FROM c GROUP BY pred_id) p ON p.cls = r.cls),
m AS (SELECT cls, CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
             CASE WHEN pred + support = 0 THEN 0.0 ELSE 2 * tp / (pred + support) END AS f1, support, tp FROM per)
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support::BIGINT AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m""")
def q_class_report(spark, sf_dir):
    r = class_report(confusion_long(rule_predictions(spark, sf_dir)))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


CANDIDATE_K = [500, 1000, 2000, 4000, 8000]
SQL_CANDIDATES = " UNION ALL ".join(
    f"SELECT {k} AS k, * FROM {SQL_RULE.format(k=k)}" for k in CANDIDATE_K)


@register("candidate_metrics", sql_metrics(f"({SQL_CANDIDATES})", group="k"))
def q_candidate_metrics(spark, sf_dir):
    return _metric_cols(_candidates_eval(spark, sf_dir), ["k"])


def _candidates_eval(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id"))
    d = table(spark, sf_dir, "documents", spread_rows=False).select("doc_id", "n_chars")
    ks = F.explode(F.array(*[F.lit(k) for k in CANDIDATE_K])).alias("k")
    preds = lab.join(d, "doc_id").select("doc_id", "label_id", "n_chars", ks)
    preds = preds.withColumn("pred_id", (F.col("n_chars") > F.col("k")).cast("int"))
    return evaluate(preds, group_cols=["k"], classes=[0, 1])


@register("best_candidate", f"""
SELECT k, f1, accuracy FROM (
  SELECT k, f1, accuracy, row_number() OVER (ORDER BY f1 DESC, k) AS rn
  FROM ({sql_metrics(f"({SQL_CANDIDATES})", group="k")})) WHERE rn = 1""")
def q_best_candidate(spark, sf_dir):
    from ..operators.select import best_by

    m = _metric_cols(_candidates_eval(spark, sf_dir), ["k"])
    return best_by(m, "f1", tie_cols=["k"]).select("k", "f1", "accuracy")



# ---------------------------------------------------------------- default ids, preview, union (PRJ4, WIN2, LIM1, SET1)
@register("default_ids", """
SELECT 'id_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS abstract_id, n_chars FROM documents""")
def q_default_ids(spark, sf_dir):
    from ..operators.labels import with_default_ids

    # as if the id column were absent; ids come from the scan's row index, so no spreading here
    d = table(spark, sf_dir, "documents", spread_rows=False).select("text", "n_chars")
    return with_default_ids(d).select("abstract_id", "n_chars")


@register("preview3", f"""
SELECT doc_id, coalesce(string_agg(h.name, '|' ORDER BY h.name), '') AS names
FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3) d LEFT JOIN {SQL_HITS} h USING (doc_id) GROUP BY doc_id""")
def q_preview3(spark, sf_dir):
    # the three rows first (a top-k of ids and texts), then their extraction
    d = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(3)
    e = d.select("doc_id", extract_terms("text", QUERY_TERMS, QUERY_HEAD).alias("extracted"))
    return e.select("doc_id", F.array_join("extracted", "|").alias("names"))


@register("union_sources", f"""
SELECT source, id, {sql_words(sql_clean('text'))} AS n_words FROM (
  SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL
  SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations)""")
def q_union_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    u = d.unionByName(c)
    return u.select("source", "id", tx.word_count(tx.clean_text("text")).cast("long").alias("n_words"))


@register("union_stats", f"""
SELECT source, count(*) AS num_samples, round(avg(length(t)), 6) AS avg_len_chars,
       CAST(max({sql_words('t')}) AS INTEGER) AS max_len_words FROM (
  SELECT 'documents' AS source, {sql_clean('text')} AS t FROM documents
  UNION ALL SELECT 'conversations', {sql_clean('text')} FROM conversations) WHERE length(t) > 0 GROUP BY source""")
def q_union_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), "text")
    u = clean_rows(d.unionByName(c))
    return u.groupBy("source").agg(
        F.count(F.lit(1)).alias("num_samples"), F.round(F.avg(F.length("text")), 6).alias("avg_len_chars"),
        F.max(tx.word_count("text")).cast("int").alias("max_len_words"))



@register("confusion_nested", f"""
SELECT CAST(to_json(list(r ORDER BY true_id)) AS VARCHAR) AS confusion_matrix FROM (
  SELECT true_id, list(n ORDER BY pred_id) AS r FROM ({SQL_CONF_LONG}) GROUP BY true_id)""")
def q_confusion_nested(spark, sf_dir):
    from ..operators.evaluate import confusion_nested

    long = confusion_long(rule_predictions(spark, sf_dir), classes=[0, 1])
    return confusion_nested(long).select(F.to_json("confusion_matrix").alias("confusion_matrix"))


from . import catalog_models  # noqa: E402,F401  (registers the model and scoring queries)
