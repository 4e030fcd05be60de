"""Registered queries, part 2: metric records, encoding, models, scoring (imported by ``catalog``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.text import word_tokens
from ..models.centroid import fit_centroids
from ..models.linear import (fit_text_lr, fit_vector_lr, predict_text, predict_vectors, select_text_lr,
                             trainable_parameters)
from ..models.nb import fit_naive_bayes
from ..operators.compare import compare, core_table, metrics_json
from ..operators.encode import build_vocab, encode
from ..operators.evaluate import class_report, confusion_long, evaluate
from ..operators.extract import extract_terms
from ..operators.labels import label_dimension, label_list, with_label_id
from ..operators.split import split_exact
from .catalog import (QUERY_HEAD, QUERY_TERMS, SEED, SQL, SQL_DOCS_PREPARED, SQL_QUERY_TERMS, SQL_RULE, TRAIN, VAL, register, sql_clean,
                      sql_metrics, sql_norm, sql_split, sql_title, table)
from ..session import materialize
from .prepare import clean_rows
from .score import NaiveBayesScorer, score_table

# ---------------------------------------------------------------- metric records (PRJ7-8, JN5, AGG16-18, FN17)
COMPARE_K = {1000: "baseline", 2000: "candidate", 4000: "nullf1"}


def _rule_metric_rows(spark, sf_dir) -> DataFrame:
    """Metrics of three rule scorers, one row each, written once."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_id"))
    d = table(spark, sf_dir, "documents", spread_rows=False).select("doc_id", "n_chars")
    ks = F.explode(F.array(*[F.lit(k) for k in COMPARE_K])).alias("k")
    preds = lab.join(d, "doc_id").select("label_id", "n_chars", ks).withColumn(
        "pred_id", (F.col("n_chars") > F.col("k")).cast("int"))
    # three rows, written once: the records below and every comparison read them
    m = materialize(evaluate(preds, group_cols=["k"], classes=[0, 1]), "metric_rows")
    name = F.element_at(F.create_map(*[x for k, v in COMPARE_K.items() for x in (F.lit(k), F.lit(v))]), F.col("k"))
    return m.withColumn("model", name)


def _metric_records(spark, sf_dir) -> DataFrame:
    """Metrics of three rule scorers as JSON in three producers' layouts, read back."""
    m = _rule_metric_rows(spark, sf_dir)
    a = metrics_json(m.where(F.col("model") == "baseline"), "evaluate", keep=["model"])
    b = metrics_json(m.where(F.col("model") == "candidate"), "trainer", keep=["model"])
    # a record where the preferred key is present but null, and a later alias holds a value
    c = m.where(F.col("model") == "nullf1").select("model", F.to_json(F.struct(
        "accuracy", F.lit(None).cast("double").alias("f1"), F.col("f1").alias("f1_score"), "precision", "recall",
        "confusion_matrix"), {"ignoreNullFields": "false"}).alias("json"))
    return core_table(a.unionByName(b).unionByName(c), keep=["model"])


SQL_COMPARE_M = f"""
(SELECT CASE k WHEN 1000 THEN 'baseline' WHEN 2000 THEN 'candidate' ELSE 'nullf1' END AS model, accuracy,
        CASE WHEN k = 4000 THEN NULL ELSE f1 END AS f1, precision, recall, tn, fp, fn, tp
 FROM ({sql_metrics('(' + ' UNION ALL '.join(f'SELECT {k} AS k, * FROM {SQL_RULE.format(k=k)}' for k in COMPARE_K) + ')', group='k', rounded=False)}))"""


@register("metrics_alias", f"""
SELECT model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision,
       round(recall, 6) AS recall, tn, fp, fn, tp FROM {SQL_COMPARE_M}""")
def q_metrics_alias(spark, sf_dir):
    c = _metric_records(spark, sf_dir)
    return c.select("model", *[F.round(x, 6).alias(x) for x in ("accuracy", "f1", "precision", "recall")],
                    "tn", "fp", "fn", "tp")


def _comparisons(spark, sf_dir):
    c = _metric_records(spark, sf_dir)
    c = materialize(c, "metric_records")
    return compare(c, "baseline", "candidate").unionByName(compare(c, "baseline", "nullf1"))


@register("compare_models", f"""
SELECT c.model AS candidate, round(c.accuracy - b.accuracy, 6) AS delta_accuracy,
       round(c.f1 - b.f1, 6) AS delta_f1, c.fp - b.fp AS delta_fp, c.fn - b.fn AS delta_fn
FROM {SQL_COMPARE_M} b JOIN {SQL_COMPARE_M} c ON b.model = 'baseline' AND c.model IN ('candidate', 'nullf1')""")
def q_compare_models(spark, sf_dir):
    r = _comparisons(spark, sf_dir)
    return r.select("candidate", F.round("delta_accuracy", 6).alias("delta_accuracy"),
                    F.round("delta_f1", 6).alias("delta_f1"), "delta_fp", "delta_fn")


@register("missing_metrics", f"""
SELECT c.model AS candidate, 'f1' AS metric
FROM {SQL_COMPARE_M} b JOIN {SQL_COMPARE_M} c ON b.model = 'baseline' AND c.model IN ('candidate', 'nullf1')
WHERE b.f1 IS NULL OR c.f1 IS NULL""")
def q_missing_metrics(spark, sf_dir):
    r = _comparisons(spark, sf_dir)
    return r.select("candidate", F.explode("missing").alias("metric"))


# ---------------------------------------------------------------- labelled corpus (documents x labels)
SQL_LAB = sql_split(
    f"""(SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS label, l.quality AS label_id, {sql_clean('d.text')} AS text
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE length({sql_clean('d.text')}) > 0)""",
    "doc_id",
)


# labels up to so many rows (of an id and a digit) are broadcast to the documents, whose texts then stay where they are
MAX_BROADCAST_ROWS = 2_000_000


def labelled(spark, sf_dir):
    """Labelled documents: cleaned, label = quality as text, label ids, exact seeded split."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    few = lab.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    dim = label_dimension(lab)
    rows = materialize(with_label_id(clean_rows(d.join(F.broadcast(lab) if few else lab, "doc_id")), "label", dim), "labelled")
    return split_exact(rows, "doc_id", TRAIN, VAL, SEED), dim


# ---------------------------------------------------------------- vocabulary and ids (ML4, FN13-14)
TOP_WORDS, MAX_LEN = 2000, 256  # MAX_LEN: the reference's default sequence length


def sql_vocab(rows: str, limit: str = "") -> str:
    return f"""
(SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id, n FROM
  (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS token FROM {rows} WHERE split = 'train')
   GROUP BY token ORDER BY n DESC, token {limit}))"""


def _vocab(spark, sf_dir, size: int | None = None):
    p, _ = labelled(spark, sf_dir)
    tr = p.where(F.col("split") == "train").select(word_tokens("text").alias("tokens"))
    return p, build_vocab(tr, "tokens", size)


@register("vocab", f"SELECT token, token_id, n FROM {sql_vocab(SQL_LAB)}")
def q_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)[1]


@register("vocab_top", f"SELECT token, token_id, n FROM {sql_vocab(SQL_LAB, f'LIMIT {TOP_WORDS}')}")
def q_vocab_top(spark, sf_dir):
    """The most frequent words only (a top-k report)."""
    return _vocab(spark, sf_dir, TOP_WORDS)[1]


def sql_encode(rows: str) -> str:
    return f"""
WITH t AS (SELECT doc_id, generate_subscripts(string_split(lower(text), ' '), 1) AS pos,
                  unnest(string_split(lower(text), ' ')) AS token FROM {rows}),
i AS (SELECT t.doc_id, t.pos, coalesce(v.token_id, 1) AS id FROM t LEFT JOIN {sql_vocab(rows)} v ON v.token = t.token
      WHERE t.pos <= {MAX_LEN})
SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) || repeat(',0', {MAX_LEN} - count(*)::INTEGER) AS input_ids,
       CAST(count(*) AS INTEGER) AS n_real
FROM i GROUP BY doc_id"""


def _encoded(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    e = encode(rows.select("doc_id", word_tokens("text").alias("tokens")), "tokens", vocab, MAX_LEN)
    return e.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


@register("encode_fixed", sql_encode(SQL_LAB))
def q_encode_fixed(spark, sf_dir):
    """Labelled documents as ids of the whole vocabulary of their train split."""
    return _encoded(*_vocab(spark, sf_dir))


@register("encode_all", sql_encode(SQL_DOCS_PREPARED))
def q_encode_all(spark, sf_dir):
    """All documents as ids of the whole vocabulary of their train split."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = split_exact(materialize(clean_rows(d), "cleaned"), "doc_id", TRAIN, VAL, SEED)
    tr = p.where(F.col("split") == "train").select(word_tokens("text").alias("tokens"))
    return _encoded(p, build_vocab(tr, "tokens"))


# ---------------------------------------------------------------- naive Bayes (ML1a, ML7-8, ML10)
SQL_NB = f"""
p AS (SELECT * FROM {SQL_LAB}),
tr AS (SELECT * FROM p WHERE split = 'train'),
cnt AS (SELECT token, label_id, count(*) AS n FROM
          (SELECT label_id, unnest(string_split(lower(text), ' ')) AS token FROM tr) GROUP BY token, label_id),
v AS (SELECT count(DISTINCT token) AS v FROM cnt),
tot AS (SELECT label_id, sum(n) AS tot FROM cnt GROUP BY label_id),
cls AS (SELECT DISTINCT label_id FROM tr),
lw AS (SELECT voc.token, cls.label_id, ln((coalesce(x.n, 0) + 1.0) / (tot.tot + v.v)) AS logp
       FROM (SELECT DISTINCT token FROM cnt) voc JOIN cls ON true JOIN tot ON tot.label_id = cls.label_id JOIN v ON true
       LEFT JOIN cnt x ON x.token = voc.token AND x.label_id = cls.label_id),
pri AS (SELECT label_id, ln(count(*) / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY label_id),
s AS (SELECT dt.doc_id, lw.label_id, sum(lw.logp) AS s
      FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM p) dt
      JOIN lw ON lw.token = dt.token GROUP BY dt.doc_id, lw.label_id),
z AS (SELECT p.doc_id, p.split, p.label_id,
             max(pri.lp + coalesce(s.s, 0)) FILTER (WHERE pri.label_id = 0) AS z0,
             max(pri.lp + coalesce(s.s, 0)) FILTER (WHERE pri.label_id = 1) AS z1
      FROM p JOIN pri ON true LEFT JOIN s ON s.doc_id = p.doc_id AND s.label_id = pri.label_id
      GROUP BY p.doc_id, p.split, p.label_id),
sc AS (SELECT doc_id, split, label_id, z0, z1, CAST(CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS INTEGER) AS pred_id,
              exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p1,
              exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p0 FROM z)"""


def _nb(spark, sf_dir):
    p, dim = labelled(spark, sf_dir)
    labels = label_list(dim)
    tr = p.where(F.col("split") == "train").select(word_tokens("text").alias("tokens"), "label_id")
    return p, fit_naive_bayes(tr, "tokens", "label_id", labels)


def _nb_scored(spark, sf_dir):
    p, model = _nb(spark, sf_dir)
    z = model.logits(p.select("doc_id", "split", "label_id", word_tokens("text").alias("tokens")), "tokens",
                     carry=["doc_id", "split", "label_id"])
    return z.select("doc_id", "split", "label_id", "logits", vx.softmax("logits").alias("probs")).withColumn(
        "pred_id", vx.argmax("probs"))


@register("nb_fit", f"WITH {SQL_NB} SELECT token, CAST(label_id AS INTEGER) AS label_id, round(logp, 6) AS logp FROM lw")
def q_nb_fit(spark, sf_dir):
    _, model = _nb(spark, sf_dir)
    return model.param_long().withColumn("logp", F.round("logp", 6))


@register("nb_score", f"""WITH {SQL_NB}
SELECT doc_id, split, pred_id, round(z0, 6) AS logit_0, round(z1, 6) AS logit_1, round(p1, 6) AS prob_1 FROM sc""")
def q_nb_score(spark, sf_dir):
    s = _nb_scored(spark, sf_dir)
    return s.select("doc_id", "split", "pred_id", F.round(F.col("logits")[0], 6).alias("logit_0"),
                    F.round(F.col("logits")[1], 6).alias("logit_1"), F.round(F.col("probs")[1], 6).alias("prob_1"))


@register("nb_score_hot_cold", SQL["nb_score"])
def q_nb_score_hot_cold(spark, sf_dir):
    """As ``nb_score``, with the parameter table joined as hot and cold words instead of a broadcast."""
    p, model = _nb(spark, sf_dir)
    z = model.logits(p.select("doc_id", "split", word_tokens("text").alias("tokens")), "tokens", carry=["doc_id", "split"], max_broadcast=0)
    s = z.withColumn("probs", vx.softmax("logits")).withColumn("pred_id", vx.argmax("probs"))
    return s.select("doc_id", "split", "pred_id", F.round(F.col("logits")[0], 6).alias("logit_0"),
                    F.round(F.col("logits")[1], 6).alias("logit_1"), F.round(F.col("probs")[1], 6).alias("prob_1"))


@register("nb_evaluate", f"WITH {SQL_NB} " + sql_metrics("sc", group="split"))
def q_nb_evaluate(spark, sf_dir):
    m = evaluate(_nb_scored(spark, sf_dir), group_cols=["split"], classes=[0, 1])
    return m.select("split", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    "tn", "fp", "fn", "tp", "support")


# ---------------------------------------------------------------- enriched predictions (ML9, PRJ5-6, ML6-7)
# the same model applied to every document
SQL_NB_ALL = SQL_NB.replace("FROM p) dt", "FROM q) dt").replace("FROM p JOIN pri", "FROM q JOIN pri").replace(
    "s.doc_id = p.doc_id", "s.doc_id = q.doc_id").replace("p.doc_id, p.split, p.label_id", "q.doc_id, q.split, q.label_id").replace(
    "tr AS (", f"""q AS (SELECT doc_id, text, 'all' AS split, NULL::INTEGER AS label_id
      FROM (SELECT doc_id, {sql_clean('text')} AS text FROM documents) WHERE length(text) > 0),
tr AS (""", 1)


@register("enriched_predictions", f"""WITH {SQL_NB_ALL},
ex AS (SELECT doc_id, string_agg(name, '|' ORDER BY name) AS names FROM (
         SELECT DISTINCT doc_id, {sql_title('m')} AS name FROM (
           SELECT doc_id, term AS m FROM documents, {SQL_QUERY_TERMS} WHERE contains(lower(text), term)
           UNION ALL
           SELECT doc_id, unnest(regexp_extract_all({sql_norm('lower(text)')}, '\\b([A-Za-z]+ {QUERY_HEAD})\\b', 1))
           FROM documents)) GROUP BY doc_id)
SELECT CAST(sc.doc_id AS VARCHAR) AS abstract_id, CAST(sc.pred_id AS VARCHAR) AS predicted_label,
       round(sc.p0, 6) AS conf_0, round(sc.p1, 6) AS conf_1, coalesce(ex.names, '') AS extracted
FROM sc LEFT JOIN ex ON ex.doc_id = sc.doc_id""")
def q_enriched_predictions(spark, sf_dir):
    """All documents scored on their cleaned text by the model fitted on the labelled ones, names extracted from the raw text – both
    from one row, so no text is joined or shuffled."""
    _, model = _nb(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = clean_rows(d.withColumn("clean", F.col("text")), "clean")
    preds = score_table(rows, NaiveBayesScorer(model), "text", "doc_id",
                        extractor=lambda c: extract_terms(c, QUERY_TERMS, QUERY_HEAD), score_col="clean")
    return flatten_predictions(preds, ["0", "1"])


def flatten_predictions(preds: DataFrame, labels: list[str]) -> DataFrame:
    return preds.select(
        "abstract_id", F.col("predicted_labels")[0].alias("predicted_label"),
        *[F.round(F.col("confidence_scores")[lab], 6).alias(f"conf_{i}") for i, lab in enumerate(labels)],
        F.array_join("extracted_diseases", "|").alias("extracted"),
    )


# ---------------------------------------------------------------- nearest centroid on frozen vectors (ML2)
SQL_EMB = sql_split("(SELECT vec_id, label, embedding FROM embeddings)", "vec_id")
SQL_CENTROID = f"""
e AS (SELECT * FROM {SQL_EMB}),
ex AS (SELECT vec_id, split, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
cent AS (SELECT label, pos, avg(x) AS m FROM ex WHERE split = 'train' GROUP BY label, pos),
d AS (SELECT ex.vec_id, ex.split, ex.label AS true_id, cent.label AS cl, sum((ex.x - cent.m) * (ex.x - cent.m)) AS dist
      FROM ex JOIN cent ON cent.pos = ex.pos GROUP BY ex.vec_id, ex.split, ex.label, cent.label),
pr AS (SELECT vec_id, split, true_id, CAST(arg_min(cl, dist) AS INTEGER) AS pred_id, min(dist) AS dist
       FROM d GROUP BY vec_id, split, true_id)"""


def _centroid_scored(spark, sf_dir):
    e = split_exact(table(spark, sf_dir, "embeddings"), "vec_id", TRAIN, VAL, SEED)
    model = fit_centroids(e.where(F.col("split") == "train"), "embedding", "label")
    s = model.predict(e, "embedding", prob_col=None)
    return s.select("vec_id", "split", F.col("label").cast("int").alias("true_id"), "pred_id",
                    F.array_min("distances").alias("dist"))


@register("centroid_score", f"WITH {SQL_CENTROID} SELECT vec_id, split, pred_id, round(dist, 6) AS dist FROM pr")
def q_centroid_score(spark, sf_dir):
    return _centroid_scored(spark, sf_dir).select("vec_id", "split", "pred_id", F.round("dist", 6).alias("dist"))


SQL_MULTI_LONG = f"""WITH {SQL_CENTROID},
t AS (SELECT * FROM pr WHERE split = 'test'),
cls AS (SELECT true_id AS c FROM t UNION SELECT pred_id FROM t)
SELECT a.c AS true_id, b.c AS pred_id, count(t.vec_id) AS n
FROM cls a JOIN cls b ON true LEFT JOIN t ON t.true_id = a.c AND t.pred_id = b.c GROUP BY a.c, b.c"""


def _multi_long(spark, sf_dir):
    s = _centroid_scored(spark, sf_dir).where(F.col("split") == "test")
    return confusion_long(s, "true_id", "pred_id")


@register("confusion_multiclass", SQL_MULTI_LONG)
def q_confusion_multiclass(spark, sf_dir):
    return _multi_long(spark, sf_dir)


def sql_class_report(long_sql: str) -> str:
    return f"""
WITH c AS ({long_sql}),
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
                 round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM m"""


@register("class_report_multiclass", sql_class_report(SQL_MULTI_LONG.replace("WITH ", "WITH ", 1)))
def q_class_report_multiclass(spark, sf_dir):
    r = class_report(_multi_long(spark, sf_dir))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# ---------------------------------------------------------------- Spark ML linear models (ML1b, ML2, ML3, AGG19)
# rows-only: iterative fits have no SQL twin
def _text_lr(spark, sf_dir, reg=0.01):
    p, _ = labelled(spark, sf_dir)
    return p, fit_text_lr(p.where(F.col("split") == "train"), "text", "label_id", num_features=1 << 16, reg_param=reg)


def _checked(out: DataFrame, key: str) -> DataFrame:
    """Scored rows with what must hold for any fit, next to the row's own columns: probabilities that sum
    to 1, the predicted id at the largest of them, and training accuracy not below the majority class."""
    out = out.withColumn("_sum", F.aggregate("probability", F.lit(0.0), lambda a, x: a + x))
    train = out.where(F.col("split") == "train")
    right = train.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_id") == F.col("label_id")).alias("ok"))
    floor = right.agg((F.sum("ok") >= F.max("n")).alias("x")).first()["x"]
    return out.select(key, "split", F.col("label_id").cast("int").alias("label_id"), (F.abs(F.col("_sum") - 1) < 1e-9).alias("sums_to_one"),
                      (F.element_at("probability", F.col("pred_id") + 1) == F.array_max("probability")).alias("is_argmax"),
                      F.lit(bool(floor)).alias("above_majority"))


SQL_CHECKS = "true AS sums_to_one, true AS is_argmax, true AS above_majority"


@register("linear_text", f"SELECT doc_id, split, CAST(label_id AS INTEGER) AS label_id, {SQL_CHECKS} FROM {SQL_LAB}")
def q_linear_text(spark, sf_dir):
    p, model = _text_lr(spark, sf_dir)
    out = predict_text(model, p.select("doc_id", "split", "label_id", "text"))
    return _checked(materialize(out.select("doc_id", "split", "label_id", "pred_id", "probability"), "linear_text"), "doc_id")


@register("linear_frozen", f"SELECT vec_id, split, CAST(label AS INTEGER) AS label_id, {SQL_CHECKS} FROM {SQL_EMB}")
def q_linear_frozen(spark, sf_dir):
    e = split_exact(table(spark, sf_dir, "embeddings"), "vec_id", TRAIN, VAL, SEED)
    model = fit_vector_lr(e.where(F.col("split") == "train"), "embedding", "label", reg_param=0.01)
    out = predict_vectors(model, e).withColumnRenamed("label", "label_id")
    return _checked(materialize(out.select("vec_id", "split", "label_id", "pred_id", "probability"), "linear_frozen"), "vec_id")


@register("linear_params", f"""
SELECT split, count(*) AS rows, CAST((max(len(embedding)) + 1) * (SELECT count(DISTINCT label) FROM embeddings) AS INTEGER) AS trainable,
       CAST(max(len(embedding)) AS INTEGER) AS input_width, CAST((SELECT count(DISTINCT label) FROM embeddings) AS INTEGER) AS classes
FROM {SQL_EMB} GROUP BY split""")
def q_linear_params(spark, sf_dir):
    e = split_exact(table(spark, sf_dir, "embeddings"), "vec_id", TRAIN, VAL, SEED)
    model = fit_vector_lr(e.where(F.col("split") == "train"), "embedding", "label", reg_param=0.01, max_iter=20)
    info = trainable_parameters(model)
    counts = e.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("split", "rows", F.lit(info["trainable"]).alias("trainable"),
                         F.lit(info["input_width"]).alias("input_width"), F.lit(info["classes"]).alias("classes"))


@register("select_best", f"""
SELECT candidate, reg_param, (SELECT count(*) FROM {SQL_LAB} WHERE split = 'val') AS support, true AS choice_is_best
FROM (VALUES (0, 0.0::DOUBLE), (1, 0.01::DOUBLE), (2, 0.1::DOUBLE)) v(candidate, reg_param)""")
def q_select_best(spark, sf_dir):
    p, _ = labelled(spark, sf_dir)
    train, val = p.where(F.col("split") == "train"), p.where(F.col("split") == "val")
    regs = [0.0, 0.01, 0.1]
    sel = select_text_lr(train, val, regs, "text", "label_id", num_features=1 << 16)
    rows = materialize(sel.table.select("candidate", "f1", "support"), "selection")
    top = rows.orderBy(F.desc("f1"), "candidate").first()["candidate"]
    reg = F.element_at(F.array(*[F.lit(r) for r in regs]), F.col("candidate") + 1)
    return rows.select("candidate", reg.alias("reg_param"), "support",
                       F.lit(regs[top] == sel.best_params["reg_param"]).alias("choice_is_best"))


# ---------------------------------------------------------------- two trained models on one test split (ML8, AGG16-18)
ALPHAS = {"baseline": 1.0, "candidate": 0.05}


def _sql_trained(alpha: float) -> str:
    nb = SQL_NB.replace("+ 1.0) / (tot.tot + v.v)", f"+ {alpha}) / (tot.tot + {alpha} * v.v)")
    return f"(WITH {nb} {sql_metrics('(SELECT * FROM sc WHERE split = ' + chr(39) + 'test' + chr(39) + ')', rounded=False)})"


@register("compare_trained", f"""
SELECT round(c.accuracy - b.accuracy, 6) AS delta_accuracy, round(c.f1 - b.f1, 6) AS delta_f1, c.fp - b.fp AS delta_fp, c.fn - b.fn AS delta_fn,
       '[[' || b.tn || ',' || b.fp || '],[' || b.fn || ',' || b.tp || ']]' AS base_matrix,
       '[[' || c.tn || ',' || c.fp || '],[' || c.fn || ',' || c.tp || ']]' AS cand_matrix
FROM {_sql_trained(ALPHAS['baseline'])} b, {_sql_trained(ALPHAS['candidate'])} c""")
def q_compare_trained(spark, sf_dir):
    """Naive Bayes with two smoothing values, fitted on the same rows and compared on the same test split."""
    p, dim = labelled(spark, sf_dir)
    labels = label_list(dim)
    tokens = materialize(p.select("doc_id", "split", "label_id", word_tokens("text").alias("tokens")), "tokens")
    scored = None
    for name, alpha in ALPHAS.items():
        model = fit_naive_bayes(tokens.where(F.col("split") == "train"), "tokens", "label_id", labels, alpha)
        z = model.logits(tokens.where(F.col("split") == "test"), "tokens", carry=["doc_id", "label_id"])
        z = z.select(F.lit(name).alias("model"), "label_id", vx.argmax("logits").alias("pred_id"))
        scored = z if scored is None else scored.unionByName(z)
    m = evaluate(scored, group_cols=["model"], classes=[0, 1])
    core = materialize(core_table(metrics_json(m, "trainer_flat", keep=["model"]), keep=["model"]), "trained_records")
    r = compare(core, "baseline", "candidate")
    return r.select(F.round("delta_accuracy", 6).alias("delta_accuracy"), F.round("delta_f1", 6).alias("delta_f1"), "delta_fp", "delta_fn",
                    F.to_json("base_confusion_matrix").alias("base_matrix"), F.to_json("cand_confusion_matrix").alias("cand_matrix"))


# ---------------------------------------------------------------- files out and in again (SRC3, SRC6-9, SNK1-2, SNK5-7)
@register("csv_round_trip", f"SELECT doc_id, label, split, md5(text) AS text_md5 FROM {SQL_LAB}")
def q_csv_round_trip(spark, sf_dir):
    """Prepared rows written as quoted CSV by split and read back with line breaks and quotes intact."""
    from ..schemas import PREPARED
    from ..session import scratch_path
    from ..sources.corpus import read_prepared_csv
    from ..sources.sinks import write_prepared

    p, _ = labelled(spark, sf_dir)
    rows = p.select(F.col("doc_id").cast("string").alias("abstract_id"), "text", "label", F.lit("").alias("filepath"),
                    F.col("label_id").cast("int").alias("label_id"), "split")
    path = scratch_path(spark, "csv_round_trip")
    write_prepared(rows.select(*PREPARED.fieldNames()), path, fmt="csv", by_split=False)
    back = read_prepared_csv(spark, path)
    return back.select(F.col("abstract_id").cast("long").alias("doc_id"), "label", "split", F.md5("text").alias("text_md5"))


@register("label_map_round_trip", """
SELECT lang AS label, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT lang FROM documents)""")
def q_label_map_round_trip(spark, sf_dir):
    from ..session import scratch_path
    from ..sources.corpus import read_label_map
    from ..sources.sinks import write_label_map

    path = scratch_path(spark, "label_map")
    write_label_map(label_dimension(table(spark, sf_dir, "documents", spread_rows=False).select(F.col("lang").alias("label"))), path)
    return read_label_map(spark, path).select("label", "label_id")


@register("model_round_trip", SQL["nb_score"])
def q_model_round_trip(spark, sf_dir):
    """The naive Bayes model saved, loaded and applied."""
    from ..models.nb import NaiveBayesModel
    from ..session import scratch_path
    from ..sources.sinks import save_model

    p, model = _nb(spark, sf_dir)
    path = scratch_path(spark, "model")
    save_model(model, path)
    z = NaiveBayesModel.load(spark, path).logits(
        p.select("doc_id", "split", word_tokens("text").alias("tokens")), "tokens", carry=["doc_id", "split"])
    s = z.withColumn("probs", vx.softmax("logits")).withColumn("pred_id", vx.argmax("probs"))
    return s.select("doc_id", "split", "pred_id", F.round(F.col("logits")[0], 6).alias("logit_0"),
                    F.round(F.col("logits")[1], 6).alias("logit_1"), F.round(F.col("probs")[1], 6).alias("prob_1"))


@register("metrics_files", f"""
SELECT k.model, round(m.accuracy, 6) AS accuracy, round(m.f1, 6) AS f1, m.tp
FROM (VALUES ('baseline'), ('candidate'), ('absent')) k(model) LEFT JOIN {SQL_COMPARE_M} m ON m.model = k.model""")
def q_metrics_files(spark, sf_dir):
    """Metric records written as files, read back by model; a model without a file gives nulls."""
    from ..session import scratch_path
    from ..sources.corpus import read_metrics
    from ..sources.sinks import write_metrics

    base, paths = scratch_path(spark, "metrics"), {}
    m = _rule_metric_rows(spark, sf_dir)
    for name, layout in (("baseline", "evaluate"), ("candidate", "trainer_flat")):
        write_metrics(metrics_json(m.where(F.col("model") == name), layout).coalesce(1), f"{base}/{name}")
        paths[name] = f"{base}/{name}"
    c = read_metrics(spark, paths | {"absent": f"{base}/absent"})
    return c.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"), "tp")


# ---------------------------------------------------------------- streams (STR1-2)
def _stream_scratch(spark):
    from ..session import scratch_path

    return scratch_path(spark, "stream")


@register("stream_score", SQL["enriched_predictions"])
def q_stream_score(spark, sf_dir):
    """``documents`` as a file stream: all rows with non-empty cleaned text, scored per micro-batch."""
    from ..functions.text import clean_text
    from ..streaming.score_stream import stream_score

    _, model = _nb(spark, sf_dir)
    base = _stream_scratch(spark)
    schema = table(spark, sf_dir, "documents").schema

    def prepare(batch: DataFrame) -> DataFrame:
        rows = batch.where(F.length(clean_text("text")) > 0)
        return rows.select(F.col("doc_id").cast("string").alias("abstract_id"), "text")

    # the table's own path: one file, or a folder of them
    q = stream_score(spark, f"{sf_dir.rstrip('/')}/documents.parquet", NaiveBayesScorer(model, clean=True), sink=f"{base}/out",
                     checkpoint=f"{base}/ckpt", schema=schema, prepare=prepare,
                     extractor=lambda c: extract_terms(c, QUERY_TERMS, QUERY_HEAD))
    q.awaitTermination()
    return flatten_predictions(spark.read.parquet(f"{base}/out").drop("batch"), ["0", "1"])


CSV_ROWS_PER_FILE = 2_500


def stream_csv_predictions(spark, sf_dir, base: str | None = None) -> DataFrame:
    """CSV copies of ``documents`` (no id column) streamed in; ids default to ``<file>#id_<row in file>``."""
    from ..schemas import PREDICTION
    from ..streaming.score_stream import stream_score_csv

    _, model = _nb(spark, sf_dir)
    base = base or _stream_scratch(spark)
    docs = table(spark, sf_dir, "documents").select("text")
    # several input files without a shuffle: the writer cuts a new file every CSV_ROWS_PER_FILE rows
    docs.write.option("header", "true").option("escape", '"').option("maxRecordsPerFile", CSV_ROWS_PER_FILE).csv(
        f"{base}/in")
    q = stream_score_csv(spark, f"{base}/in", NaiveBayesScorer(model, clean=True), f"{base}/out", f"{base}/ckpt",
                         extractor=lambda c: extract_terms(c, QUERY_TERMS, QUERY_HEAD))
    q.awaitTermination()
    return spark.read.schema(PREDICTION).json(f"{base}/out").drop("batch")


@register("stream_csv", f"SELECT predicted_label, conf_0, conf_1, extracted, true AS id_names_file FROM ({SQL['enriched_predictions']})")
def q_stream_csv(spark, sf_dir):
    """File names differ from run to run, so rows are told apart by what was predicted for them."""
    p = stream_csv_predictions(spark, sf_dir)
    return flatten_predictions(p, ["0", "1"]).withColumn("id_names_file", F.col("abstract_id").rlike(r"^part-.*csv#id_\d+$")).drop("abstract_id")


@register("stream_csv_rows", f"""WITH {SQL_NB_ALL}
SELECT md5(d.text) AS text_md5, CAST(sc.pred_id AS VARCHAR) AS predicted_label, round(sc.p0, 6) AS conf_0, round(sc.p1, 6) AS conf_1
FROM sc JOIN documents d ON d.doc_id = sc.doc_id""")
def q_stream_csv_rows(spark, sf_dir):
    """The streamed CSV rows told apart by id: ``<file>#id_<row>`` leads back to the row's text in the input file."""
    from ..sources.corpus import CSV_OPTIONS, file_ordinal

    base = _stream_scratch(spark)
    p = flatten_predictions(stream_csv_predictions(spark, sf_dir, base), ["0", "1"])
    rows = spark.read.options(**CSV_OPTIONS).schema("text string").csv(f"{base}/in").withColumn("_path", F.col("_metadata.file_path"))
    rows = file_ordinal(rows, "_row", path_col="_path")
    name = F.concat(F.regexp_extract("_path", r"([^/]+)$", 1), F.lit("#id_"), F.col("_row").cast("string"))
    rows = rows.select(name.alias("abstract_id"), F.md5("text").alias("text_md5"))
    return p.join(rows, "abstract_id", "left").select("text_md5", "predicted_label", "conf_0", "conf_1")


@register("stream_restart", SQL["enriched_predictions"])
def q_stream_restart(spark, sf_dir):
    """A stream whose sink fails after it wrote its second batch, started again from the same checkpoint: every row once."""
    from pyspark.errors import StreamingQueryException

    from ..functions.text import clean_text
    from ..streaming.score_stream import stream_score

    _, model = _nb(spark, sf_dir)
    base = _stream_scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartition(4).write.parquet(f"{base}/in")

    def prepare(batch: DataFrame) -> DataFrame:
        rows = batch.where(F.length(clean_text("text")) > 0)
        return rows.select(F.col("doc_id").cast("string").alias("abstract_id"), "text")

    def fail(epoch: int) -> None:
        if epoch == 1:
            raise RuntimeError("the sink fails")

    def start(on_batch=None):
        return stream_score(spark, f"{base}/in", NaiveBayesScorer(model, clean=True), sink=f"{base}/out", checkpoint=f"{base}/ckpt", schema=docs.schema,
                            prepare=prepare, max_files=1, extractor=lambda c: extract_terms(c, QUERY_TERMS, QUERY_HEAD), on_batch=on_batch)

    try:
        start(fail).awaitTermination()
        raise AssertionError("the first run must fail")
    except StreamingQueryException:
        pass
    start().awaitTermination()
    return flatten_predictions(spark.read.parquet(f"{base}/out").drop("batch"), ["0", "1"])


# ---------------------------------------------------------------- an outside model (UDF3) and a metric of one's own (UDF1)
# counts of " ", "e" and line breaks, and the length; logit of class 1
OUTSIDE = {"space": -0.02, "e": 0.01, "line": 0.03, "length": 0.001, "bias": -0.5}


def _load_outside():
    import json

    return json.loads(json.dumps(OUTSIDE))


def _outside_logits(model, texts):
    import numpy as np
    import pyarrow.compute as pc

    count = lambda x: pc.count_substring(texts, x).to_numpy(zero_copy_only=False).astype(float)
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    z = model["space"] * count(" ") + model["e"] * count("e") + model["line"] * count("\n") + model["length"] * length + model["bias"]
    return np.stack([np.zeros(len(z)), z], axis=1)


def _sql_times(x: str) -> str:
    return f"(length(t) - length(replace(t, {x}, '')))"


@register("outside_model", f"""
SELECT CAST(doc_id AS VARCHAR) AS abstract_id, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS predicted_label,
       round(1 / (1 + exp(-z)), 6) AS conf_high
FROM (SELECT doc_id, {OUTSIDE['space']} * {_sql_times("' '")} + {OUTSIDE['e']} * {_sql_times("'e'")} + {OUTSIDE['line']} * {_sql_times('chr(10)')}
             + {OUTSIDE['length']} * length(t) + ({OUTSIDE['bias']}) AS z FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def q_outside_model(spark, sf_dir):
    """A model outside Spark over the whole table: Arrow batches bounded by bytes, the model loaded once a worker."""
    from .score import ArrowScorer

    scorer = ArrowScorer(_outside_logits, ["low", "high"], _load_outside, batch_bytes=1 << 20)
    p = score_table(table(spark, sf_dir, "documents").select("doc_id", "text"), scorer, "text", "doc_id", extractor=lambda c: F.array().cast("array<string>"))
    return p.select("abstract_id", F.col("predicted_labels")[0].alias("predicted_label"), F.round(F.col("confidence_scores")["high"], 6).alias("conf_high"))


def _balanced_accuracy(true, pred, n) -> float:
    import numpy as np

    classes = np.unique(true)
    return float(np.mean([n[(true == c) & (pred == c)].sum() / n[true == c].sum() for c in classes]))


@register("custom_metric", f"""WITH {SQL_NB}
SELECT split, round(avg(r), 6) AS balanced_accuracy FROM (
  SELECT split, label_id, avg(CASE WHEN pred_id = label_id THEN 1.0 ELSE 0.0 END) AS r FROM sc GROUP BY split, label_id) GROUP BY split""")
def q_custom_metric(spark, sf_dir):
    """A metric written by the user, per split, over the counted pairs."""
    from ..operators.evaluate import custom_metrics

    m = custom_metrics(_nb_scored(spark, sf_dir), _balanced_accuracy, "balanced_accuracy", group_cols=["split"])
    return m.select("split", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


# ---------------------------------------------------------------- many classes (AGG13-15)
MANY = 50_021
SQL_MANY = f"(SELECT n_chars % {MANY} AS label_id, (n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % {MANY} AS pred_id FROM documents)"


def _many_classes(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents", spread_rows=False)
    off = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return d.select((F.col("n_chars") % MANY).cast("int").alias("label_id"), ((F.col("n_chars") + off) % MANY).cast("int").alias("pred_id"))


@register("many_class_pairs", f"SELECT CAST(label_id AS INTEGER) AS true_id, CAST(pred_id AS INTEGER) AS pred_id, count(*) AS n FROM {SQL_MANY} GROUP BY 1, 2")
def q_many_class_pairs(spark, sf_dir):
    """The confusion matrix of up to 50,021 classes as its occurring cells."""
    from ..operators.evaluate import confusion_sparse

    return confusion_sparse(_many_classes(spark, sf_dir))


@register("many_class_report", f"""
WITH c AS (SELECT label_id AS t, pred_id AS p, count(*) AS n FROM {SQL_MANY} GROUP BY 1, 2),
cls AS (SELECT t AS k FROM c UNION SELECT p FROM c),
m AS (SELECT k, coalesce((SELECT sum(n) FROM c WHERE t = k), 0) AS sup, coalesce((SELECT sum(n) FROM c WHERE p = k), 0) AS pr,
             coalesce((SELECT sum(n) FROM c WHERE t = k AND p = k), 0) AS tp FROM cls),
r AS (SELECT sup, tp, CASE WHEN pr = 0 THEN 0.0 ELSE tp / pr END AS pc, CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS rc,
             CASE WHEN pr + sup = 0 THEN 0.0 ELSE 2 * tp / (pr + sup) END AS f FROM m)
SELECT 'accuracy' AS class, NULL AS precision, NULL AS recall, round(sum(tp) / sum(sup), 6) AS f1, CAST(sum(sup) AS BIGINT) AS support FROM r
UNION ALL SELECT 'macro avg', round(avg(pc), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(sup) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(pc * sup) / sum(sup), 6), round(sum(rc * sup) / sum(sup), 6), round(sum(f * sup) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM r""")
def q_many_class_report(spark, sf_dir):
    """Summary rows of the report over the occurring pairs; no class x class grid is built."""
    from ..operators.evaluate import confusion_sparse

    r = class_report(confusion_sparse(_many_classes(spark, sf_dir))).where(F.col("class_id").isNull())
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


from . import catalog_files  # noqa: E402,F401  (registers the queries on files, texts and parameters)
from . import catalog_fits  # noqa: E402,F401  (registers the fits that SQL repeats)
