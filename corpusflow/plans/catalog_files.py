"""Registered queries, part 3: files in and out, single texts, display strings, parameters (imported by ``catalog``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.text import word_tokens
from ..models.nb import fit_naive_bayes
from ..operators.evaluate import evaluate
from ..operators.extract import extract_terms
from ..operators.labels import label_list
from ..schemas import PREDICTION
from ..session import discard, freed_shuffles, materialize, scratch_path
from ..sources import corpus as src
from ..sources import sinks
from .catalog import (QUERY_HEAD, QUERY_TERMS, SEED, SQL_DOCS_PREPARED, SQL_QUERY_TERMS, TRAIN, VAL, prepared_stats, register, sql_clean,
                      sql_metrics, sql_norm, sql_split, sql_title, sql_words, table)
from .catalog_models import SQL_NB, SQL_NB_ALL, _comparisons, _nb, flatten_predictions, labelled, SQL_COMPARE_M
from .prepare import prepare
from .score import NaiveBayesScorer, score_table, score_text

# ---------------------------------------------------------------- class folders (SRC1-2, PRJ3, SRT1, SNK2)
SQL_FOLDERS = sql_split(
    f"(SELECT CAST(doc_id AS VARCHAR) AS abstract_id, lang AS label, {sql_clean('text')} AS text FROM documents WHERE length({sql_clean('text')}) > 0)",
    "abstract_id",
)


@register("folder_splits", f"""
SELECT abstract_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, split, md5(text) AS text_md5,
       row_number() OVER (PARTITION BY split ORDER BY label || '/' || abstract_id || '.txt') - 1 AS pos
FROM {SQL_FOLDERS}""")
def q_folder_splits(spark, sf_dir):
    """``documents`` as class folders of text files (class: language), read, prepared and written by split in path order.

    ``pos`` is a row's place in its split's files, so the order of the export is checked too.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("abstract_id"), "text", F.col("lang").alias("label"))
    root, out = scratch_path(spark, "folders"), scratch_path(spark, "by_split")
    sinks.write_class_folders(d, root)
    langs = [r[0] for r in table(spark, sf_dir, "documents", spread_rows=False).select("lang").distinct().limit(1000).collect()]
    with src.packed_scan(spark):  # the small files are read once, by the job that writes the cleaned rows
        prepared, _ = prepare(src.read_class_folders(spark, root), "abstract_id", "text", "label", TRAIN, VAL, SEED)
    src.require_labels(prepared, langs, root)
    sinks.delete_files(prepared, "filepath", root)  # by many tasks
    discard(spark, root)
    with freed_shuffles(spark):
        sinks.write_prepared(prepared, out, order_by="filepath")
    return src.export_positions(spark, out).select("abstract_id", "label", F.col("label_id").cast("int").alias("label_id"), "split",
                                                   F.md5("text").alias("text_md5"), "pos")


# ---------------------------------------------------------------- statistics as files (SNK4)
@register("stats_files", f"""
SELECT CASE WHEN grouping(split) = 1 THEN 'global' ELSE split END AS scope, count(*) AS num_samples,
       round(avg(length(text)), 6) AS avg_len_chars, round(avg({sql_words('text')}), 6) AS avg_len_words,
       min({sql_words('text')}) AS min_len_words, max({sql_words('text')}) AS max_len_words,
       count(*) FILTER (WHERE label = 'en') AS n_en, count(*) FILTER (WHERE label = 'fr') AS n_fr
FROM {SQL_DOCS_PREPARED} GROUP BY GROUPING SETS ((split), ())""")
def q_stats_files(spark, sf_dir):
    """Statistics written as JSON, one record a scope, and read back with their label counts."""
    path = scratch_path(spark, "stats")
    sinks.write_stats(prepared_stats(spark, sf_dir), path)
    s = spark.read.schema("scope string, num_samples long, label_counts map<string,long>, avg_len_chars double, avg_len_words double, "
                          "min_len_words long, max_len_words long").json(path)
    zero = F.lit(0).cast("long")
    return s.select("scope", "num_samples", F.round("avg_len_chars", 6).alias("avg_len_chars"), F.round("avg_len_words", 6).alias("avg_len_words"),
                    "min_len_words", "max_len_words", *[F.coalesce(F.col("label_counts")[x], zero).alias(f"n_{x}") for x in ("en", "fr")])


# ---------------------------------------------------------------- a scoring file (SRC4, SNK5)
SQL_RAW_NAMES = f"""
ex AS (SELECT doc_id, string_agg(name, '|' ORDER BY name) AS names FROM (
         SELECT DISTINCT doc_id, {sql_title('m')} AS name FROM (
           SELECT doc_id, term AS m FROM documents, {SQL_QUERY_TERMS} WHERE contains(lower(text), term)
           UNION ALL
           SELECT doc_id, unnest(regexp_extract_all({sql_norm('lower(text)')}, '\\b([A-Za-z]+ {QUERY_HEAD})\\b', 1))
           FROM documents)) GROUP BY doc_id)"""
CSV_FILE_ROWS = 1_000


def _names(c):
    return extract_terms(c, QUERY_TERMS, QUERY_HEAD)


@register("scoring_csv", f"""WITH {SQL_NB_ALL}, {SQL_RAW_NAMES},
ids AS (SELECT doc_id, 'id_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS abstract_id FROM documents)
SELECT ids.abstract_id, CAST(sc.pred_id AS VARCHAR) AS predicted_label, round(sc.p0, 6) AS conf_0, round(sc.p1, 6) AS conf_1,
       coalesce(ex.names, '') AS extracted
FROM ids JOIN sc ON sc.doc_id = ids.doc_id LEFT JOIN ex ON ex.doc_id = ids.doc_id""")
def q_scoring_csv(spark, sf_dir):
    """All texts as CSV files without an id column, read with default ids over all files, scored, and the
    records written as JSON lines and read back."""
    _, model = _nb(spark, sf_dir)
    texts, out = scratch_path(spark, "scoring_csv"), scratch_path(spark, "predictions")
    rows = table(spark, sf_dir, "documents", spread_rows=False).orderBy("doc_id").select("text")
    with freed_shuffles(spark):
        rows.write.option("header", "true").option("escape", '"').option("maxRecordsPerFile", CSV_FILE_ROWS).csv(texts, compression="gzip")
    preds = score_table(src.read_scoring_csv(spark, texts), NaiveBayesScorer(model, clean=True), extractor=_names)
    sinks.write_predictions(preds, out)
    return flatten_predictions(spark.read.schema(PREDICTION).json(out), ["0", "1"])


# ---------------------------------------------------------------- one literal text (SRC5, ML6)
ONE_TEXT = "A note of the results: in the section the question and the reaction. Die Frage der Zeit."
SQL_ONE = SQL_NB_ALL.replace("FROM documents) WHERE length(text) > 0)", f"FROM (SELECT 0 AS doc_id, '{ONE_TEXT}' AS text)) WHERE length(text) > 0)")


@register("score_one_text", f"""WITH {SQL_ONE}
SELECT 'manual_input' AS abstract_id, CAST(sc.pred_id AS VARCHAR) AS predicted_label, round(sc.p0, 6) AS conf_0, round(sc.p1, 6) AS conf_1,
       (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT DISTINCT {sql_title('m')} AS name FROM (
           SELECT term AS m FROM {SQL_QUERY_TERMS} WHERE contains(lower('{ONE_TEXT}'), term)
           UNION ALL SELECT unnest(regexp_extract_all(lower('{ONE_TEXT}'), '\\b([A-Za-z]+ {QUERY_HEAD})\\b', 1))))) AS extracted
FROM sc""")
def q_score_one_text(spark, sf_dir):
    """One literal text through the model of the labelled documents."""
    _, model = _nb(spark, sf_dir)
    return flatten_predictions(score_text(spark, ONE_TEXT, NaiveBayesScorer(model, clean=True), extractor=_names), ["0", "1"])


# ---------------------------------------------------------------- display strings of a comparison (FN15)
@register("compare_texts", f"""
SELECT c.model AS candidate, printf('%.4f', b.accuracy) AS base_accuracy_text, printf('%.4f', c.accuracy) AS cand_accuracy_text,
       printf('%+.4f', c.accuracy - b.accuracy) AS delta_accuracy_text,
       CASE WHEN b.f1 IS NOT NULL AND c.f1 IS NOT NULL THEN printf('%+.4f', c.f1 - b.f1) END AS delta_f1_text
FROM {SQL_COMPARE_M} b JOIN {SQL_COMPARE_M} c ON b.model = 'baseline' AND c.model IN ('candidate', 'nullf1')""")
def q_compare_texts(spark, sf_dir):
    return _comparisons(spark, sf_dir).select("candidate", "base_accuracy_text", "cand_accuracy_text", "delta_accuracy_text", "delta_f1_text")


# ---------------------------------------------------------------- hyper-parameters as arguments (ML5)
GRID = [0.01, 0.5, 4.0]


def _sql_grid(alpha: float) -> str:
    nb = SQL_NB.replace("+ 1.0) / (tot.tot + v.v)", f"+ {alpha}) / (tot.tot + {alpha} * v.v)")
    return f"SELECT {alpha}::DOUBLE AS alpha, * FROM (WITH {nb} {sql_metrics('sc', group='split')})"


@register("parameter_grid", " UNION ALL ".join(_sql_grid(a) for a in GRID))
def q_parameter_grid(spark, sf_dir):
    """Naive Bayes for each smoothing value of a grid, all predictions evaluated in one grouped aggregate."""
    p, dim = labelled(spark, sf_dir)
    tokens = materialize(p.select("doc_id", "split", "label_id", word_tokens("text").alias("tokens")), "grid_tokens")
    labels, scored = label_list(dim), None
    for alpha in GRID:
        model = fit_naive_bayes(tokens.where(F.col("split") == "train"), "tokens", "label_id", labels, alpha=alpha)
        z = model.logits(tokens, "tokens", carry=["split", "label_id"])
        z = z.select(F.lit(alpha).alias("alpha"), "split", "label_id", vx.argmax("logits").alias("pred_id"))
        scored = z if scored is None else scored.unionByName(z)
    m = evaluate(scored, group_cols=["alpha", "split"], classes=[0, 1])
    return m.select("alpha", "split", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "tn", "fp", "fn", "tp", "support")


# ---------------------------------------------------------------- many metric files in one scan (SRC7-8)
N_GROUPS = 1_000


@register("metrics_many_files", f"""
WITH r AS (SELECT 'm' || CAST(l.doc_id % {N_GROUPS} AS VARCHAR) AS model, l.quality AS label_id, CAST(d.n_chars > 2000 AS INTEGER) AS pred_id
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
m AS ({sql_metrics('r', group='model')})
SELECT 'm' || CAST(i AS VARCHAR) AS model, m.accuracy, m.f1, m.tn, m.fp, m.fn, m.tp
FROM range({N_GROUPS}) x(i) LEFT JOIN m ON m.model = 'm' || CAST(i AS VARCHAR)""")
def q_metrics_many_files(spark, sf_dir):
    """Metrics of up to a thousand groups written as a file each and read back in one scan; groups without a file give nulls."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id"))
    d = table(spark, sf_dir, "documents", spread_rows=False).select("doc_id", "n_chars")
    preds = lab.join(d, "doc_id").select(
        F.concat(F.lit("m"), (F.col("doc_id") % N_GROUPS).cast("string")).alias("model"), "label_id", (F.col("n_chars") > 2000).cast("int").alias("pred_id"))
    from ..operators.compare import metrics_json

    base = scratch_path(spark, "metrics_many")
    sinks.write_metrics(metrics_json(evaluate(preds, group_cols=["model"], classes=[0, 1]), "trainer", keep=["model"]), base)
    c = src.read_metrics(spark, {f"m{i}": f"{base}/model=m{i}" for i in range(N_GROUPS)})
    return c.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"), "tn", "fp", "fn", "tp")
