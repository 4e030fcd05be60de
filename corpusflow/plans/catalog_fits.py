"""Registered queries, part 4: fits whose every coefficient SQL repeats (imported by ``catalog``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..models.gradient import Candidate, epoch_metrics, fit_epochs, fit_head, hashed_counts, select_epoch
from ..operators.split import split_exact
from ..session import materialize
from .catalog import SEED, TRAIN, VAL, register, sql_metrics, sql_split, table
from .catalog_models import SQL_LAB, labelled

DIMS = 64
TEXT_FIT = {"rate": 8.0, "l2": 0.001, "steps": 20}
HEAD_FIT = {"rate": 1.0, "l2": 0.01, "steps": 20}
GRID = [Candidate(1.0, 0.0), Candidate(8.0, 0.001), Candidate(8.0, 0.1)]
EPOCHS, STEPS = 3, 6

# ---------------------------------------------------------------- SQL: unit count vectors, gradient steps by recursion
SQL_TEXT_ROWS = f"""
t AS (SELECT doc_id AS id, split, label_id, unnest(string_split(lower(text), ' ')) AS w FROM {SQL_LAB}),
c AS (SELECT id, split, label_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % {DIMS} AS b, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT id, split, label_id, list_transform(range({DIMS}), lambda i: coalesce(ln(1 + map_extract(m, CAST(i AS INTEGER))[1]::DOUBLE), 0.0)) AS v
      FROM (SELECT id, split, label_id, map(list(b), list(n)) AS m FROM c GROUP BY ALL)),
rows AS (SELECT id, split, CAST(label_id AS INTEGER) AS y, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS x FROM g)"""

SQL_VECTOR_ROWS = f"""
rows AS (SELECT vec_id AS id, split, CAST(label >= 5 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS x
         FROM {sql_split('(SELECT vec_id, label, embedding FROM embeddings)', 'vec_id')})"""


def sql_steps(rows: str, candidates: list[Candidate], steps: int) -> str:
    """WITH clauses that end in ``w``: the weights (bias last) of every candidate after every step."""
    grid = ", ".join(f"({i}, {c.rate}::DOUBLE, {c.l2}::DOUBLE)" for i, c in enumerate(candidates))
    return f"""WITH RECURSIVE {rows},
tr AS (SELECT list_append(x, 1.0::DOUBLE) AS x, y FROM rows WHERE split = 'train'),
k(candidate, rate, l2) AS (VALUES {grid}),
w(candidate, step, v) AS (
  SELECT candidate, 0, list_transform(range({DIMS} + 1), lambda i: 0.0::DOUBLE) FROM k
  UNION ALL
  SELECT candidate, step + 1, list(nv ORDER BY i) FROM (
    SELECT w.candidate, w.step, i, w.v[i] - any_value(k.rate) * (sum(r * x[i]) / count(*) + CASE WHEN i <= {DIMS} THEN any_value(k.l2) * w.v[i] ELSE 0 END) AS nv
    FROM (SELECT w.candidate, w.step, w.v, tr.x, 1 / (1 + exp(-list_dot_product(w.v, tr.x))) - tr.y AS r FROM w, tr WHERE w.step < {steps}) w
         JOIN k ON k.candidate = w.candidate, range(1, {DIMS} + 2) q(i)
    GROUP BY w.candidate, w.step, w.v, i) GROUP BY candidate, step)"""


def _text_rows(spark, sf_dir) -> DataFrame:
    """Labelled documents as unit vectors of hashed word counts, written once."""
    p, _ = labelled(spark, sf_dir)
    tokens = p.select("doc_id", "split", F.col("label_id").cast("int").alias("label_id"), word_tokens("text").alias("tokens"))
    return materialize(hashed_counts(tokens, "tokens", DIMS, ["doc_id", "split", "label_id"]), "count_vectors")


def _vector_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("label_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return materialize(split_exact(e, "vec_id", TRAIN, VAL, SEED), "frozen_vectors")


def _weights(head, spark) -> DataFrame:
    rows = [(i, float(w)) for i, w in enumerate([*head.weights, head.bias])]
    return spark.createDataFrame(rows, "place int, weight double").withColumn("weight", F.round("weight", 6))


def _train(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == "train")


# ---------------------------------------------------------------- ML1b: a text classifier
def _sql_weights(rows: str, fit: dict) -> str:
    return f"""{sql_steps(rows, [Candidate(fit['rate'], fit['l2'])], fit['steps'])}
SELECT CAST(i - 1 AS INTEGER) AS place, round(v[i], 6) AS weight FROM w, range(1, {DIMS} + 2) q(i) WHERE step = {fit['steps']}"""


@register("gradient_text_weights", _sql_weights(SQL_TEXT_ROWS, TEXT_FIT))
def q_gradient_text_weights(spark, sf_dir):
    return _weights(fit_head(_train(_text_rows(spark, sf_dir)), **TEXT_FIT), spark)


@register("gradient_text", f"""{sql_steps(SQL_TEXT_ROWS, [Candidate(TEXT_FIT['rate'], TEXT_FIT['l2'])], TEXT_FIT['steps'])}
SELECT id AS doc_id, split, CAST(z > 0 AS INTEGER) AS pred_id, round(1 / (1 + exp(-z)), 6) AS prob_1
FROM (SELECT id, split, list_dot_product(v, list_append(x, 1.0::DOUBLE)) AS z FROM rows, w WHERE step = {TEXT_FIT['steps']})""")
def q_gradient_text(spark, sf_dir):
    """All labelled documents scored by the text classifier that was fitted on their train split."""
    rows = _text_rows(spark, sf_dir)
    head = fit_head(_train(rows), **TEXT_FIT)
    z = rows.select("doc_id", "split", F.explode(F.array(head.logit("features"))).alias("z"))
    return z.select("doc_id", "split", (F.col("z") > 0).cast("int").alias("pred_id"), F.round(1 / (1 + F.exp(-F.col("z"))), 6).alias("prob_1"))


# ---------------------------------------------------------------- ML2: a head on frozen vectors
@register("gradient_frozen_weights", _sql_weights(SQL_VECTOR_ROWS, HEAD_FIT))
def q_gradient_frozen_weights(spark, sf_dir):
    return _weights(fit_head(_train(_vector_rows(spark, sf_dir)), **HEAD_FIT), spark)


@register("gradient_frozen", f"""{sql_steps(SQL_VECTOR_ROWS, [Candidate(HEAD_FIT['rate'], HEAD_FIT['l2'])], HEAD_FIT['steps'])},
sc AS (SELECT split, y AS label_id, CAST(list_dot_product(v, list_append(x, 1.0::DOUBLE)) > 0 AS INTEGER) AS pred_id FROM rows, w WHERE step = {HEAD_FIT['steps']})
{sql_metrics('sc', group='split')}""")
def q_gradient_frozen(spark, sf_dir):
    """The head's metrics on every split (it is fitted on train)."""
    rows = _vector_rows(spark, sf_dir)
    m = epoch_metrics(rows, [[fit_head(_train(rows), **HEAD_FIT)]], group_cols=["split"])
    return m.select("split", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "tn", "fp", "fn", "tp", "support")


# ---------------------------------------------------------------- ML3: every epoch of every candidate on the validation split
SQL_EPOCHS = f"""{sql_steps(SQL_TEXT_ROWS, GRID, EPOCHS * STEPS)},
sc AS (SELECT candidate * {EPOCHS} + step // {STEPS} AS ce, y AS label_id, CAST(list_dot_product(v, list_append(x, 1.0::DOUBLE)) > 0 AS INTEGER) AS pred_id
       FROM rows, w WHERE split = 'val' AND step > 0 AND step % {STEPS} = 0),
m AS ({sql_metrics('sc', group='ce', rounded=False)})"""


@register("gradient_select", f"""{SQL_EPOCHS}
SELECT CAST((ce - 1) // {EPOCHS} AS INTEGER) AS candidate, CAST((ce - 1) % {EPOCHS} + 1 AS INTEGER) AS epoch, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
       support, row_number() OVER (ORDER BY f1 DESC, ce) = 1 AS chosen FROM m""")
def q_gradient_select(spark, sf_dir):
    """A grid fitted in one aggregate a step, every epoch scored on the validation split in one pass, the best taken."""
    rows = _text_rows(spark, sf_dir)
    heads = fit_epochs(_train(rows), GRID, epochs=EPOCHS, steps=STEPS)
    _, m = select_epoch(rows.where(F.col("split") == "val"), heads)
    return m.select("candidate", "epoch", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"), "support", "chosen")
