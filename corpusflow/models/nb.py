"""Multinomial naive Bayes on word tokens – fitted and applied with DataFrame operators only.

Fit: one row per token with its count in each class (explode + partial aggregation: hot tokens collapse
map-side), written once to the shared folder, which cuts the lineage back to the corpus; class totals and
vocabulary size come from that table. The parameter table is a projection of it: one row per token with
the log-probabilities of all classes (``ln((n + alpha) / (total_label + alpha * V))``).

Score: each row's tokens are exploded, joined to the parameter table (broadcast when its checked
size allows, else its most frequent words only; the other words go to the rest of the table by a
shuffle), and summed back per row. Tokens outside the vocabulary drop out; a row with no known token
keeps its prior. The per-row regroup is keyed by a per-row id made in the same task as the explode, and
carries only the small columns the caller asks for, so the text itself never crosses a shuffle.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# parameter tables up to this many bytes (estimated) are broadcast to the scoring join
MAX_BROADCAST_BYTES = 64 << 20
# of a larger table the most frequent words are broadcast: as many as fit the bytes above, and about so many at least
HOT_WORDS = 10_000


@dataclass
class NaiveBayesModel:
    labels: list[str]
    log_priors: list[float]
    params: DataFrame  # token string, logp array<double> (index = label id)
    vocab_size: int
    alpha: float = 1.0
    token_bytes: int = 0  # of all tokens of the vocabulary
    _least_level: dict = field(default_factory=dict, repr=False, compare=False)  # of the hot words, by their bytes

    @property
    def num_classes(self) -> int:
        return len(self.labels)

    def param_long(self) -> DataFrame:
        """``token, label_id, logp`` – the parameter table in long form."""
        return self.params.select("token", F.posexplode("logp").alias("label_id", "logp")).withColumn(
            "label_id", F.col("label_id").cast("int"))

    def save(self, path: str) -> None:
        spark = self.params.sparkSession
        self.params.write.mode("overwrite").parquet(f"{path}/params")
        meta = {"labels": self.labels, "log_priors": self.log_priors, "vocab_size": self.vocab_size, "alpha": self.alpha,
                "token_bytes": self.token_bytes}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NaiveBayesModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return NaiveBayesModel(meta["labels"], meta["log_priors"], spark.read.parquet(f"{path}/params"),
                               int(meta["vocab_size"]), float(meta["alpha"]), int(meta["token_bytes"]))

    def _row_bytes(self) -> int:
        return 8 * self.num_classes + 48

    def hot_words(self, max_bytes: int) -> DataFrame:
        """The rows of the parameter table's most frequent words that together take at most ``max_bytes`` (estimated).

        A word's largest log-probability tells how frequent it is. Words are counted by its quarter units (some
        hundred numbers), and whole units are taken from the top.
        """
        level = F.floor(F.coalesce(F.array_max("logp"), F.lit(-1e6)) * 4)
        if max_bytes not in self._least_level:
            counts = self.params.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("b"))
            least, left = None, max_bytes
            for r in sorted(counts.collect(), reverse=True):
                left -= r["n"] * self._row_bytes() + r["b"]
                if left < 0:
                    break
                least = r["level"]
            self._least_level[max_bytes] = least
        least = self._least_level[max_bytes]
        return self.params.where(F.lit(False) if least is None else level >= F.lit(least))

    def logits(self, df: DataFrame, tokens_col: str = "tokens", carry: list[str] | None = None,
               out_col: str = "logits", max_broadcast: int = MAX_BROADCAST_BYTES, hot_words: int = HOT_WORDS) -> DataFrame:
        """``carry..., logits array<double>`` for every row of ``df``.

        A parameter table of at most ``max_broadcast`` bytes is broadcast. Of a larger one the most frequent words are
        (``max_broadcast`` bytes of them, or about ``hot_words`` if that is more): most words of a row are summed where
        the row is, and only the others, each once a row with its count, are written and joined to the whole table.
        """
        carry = list(carry if carry is not None else [c for c in df.columns if c != tokens_col])
        key = "_cf_row"
        k = self.num_classes
        # the row id is made in a projection below the explode (one id per input row)
        keyed = df.select(F.monotonically_increasing_id().alias(key), *carry, F.col(tokens_col).alias("_cf_tokens"))
        sums = [f"_s{i}" for i in range(k)]
        est = self.vocab_size * self._row_bytes() + self.token_bytes
        if est <= max_broadcast:
            ex = keyed.select(key, *carry, F.explode_outer("_cf_tokens").alias("token"))
            j = ex.join(F.broadcast(self.params.select("token", "logp")), "token", "left")
            # the carried columns are fixed per row id, so they join the grouping key: the aggregate
            # buffers stay fixed-width sums (hash aggregation, partial per task) instead of first() over
            # arbitrary types, which would force a sort of every token occurrence
            per = j.groupBy(key, *carry).agg(*[F.sum(F.col("logp")[i]).alias(s) for i, s in enumerate(sums)])
        else:
            per = self._hot_cold_sums(keyed, key, carry, sums, max(max_broadcast, hot_words * (self._row_bytes() + 16)))
        logits = F.array(*[F.lit(self.log_priors[i]) + F.coalesce(F.col(s), F.lit(0.0)) for i, s in enumerate(sums)])
        return per.select(*carry, logits.alias(out_col))

    def _hot_cold_sums(self, keyed: DataFrame, key: str, carry: list[str], sums: list[str], hot_bytes: int) -> DataFrame:
        """``key, carry..., sums...``: as the broadcast's, with hot words summed in place and cold ones joined by shuffle.

        One pass gives a row's sums over its hot words (a row without a word) and its cold words with their counts;
        the carried columns stay with the former. The pass is written, so that row ids are made once.
        """
        side = self.params.select("token", "logp")
        hot = self.hot_words(hot_bytes).select("token", "logp")
        # a null word after a row's own ones: every row has sums (the outer form, since a plain explode brings a
        # filter on its array, for which the words would be made once more)
        words = F.array_append(F.coalesce("_cf_tokens", F.array().cast("array<string>")), F.lit(None).cast("string"))
        ex = keyed.select(key, *carry, F.explode_outer(words).alias("token"))
        j = ex.join(F.broadcast(hot), "token", "left")
        cold = F.when(F.col("logp").isNull(), F.col("token"))
        j = j.select(key, "logp", cold.alias("_word"), *[F.when(cold.isNull(), F.col(c)).alias(c) for c in carry])
        per = j.groupBy(key, "_word", *carry).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("logp")[i]).alias(s) for i, s in enumerate(sums)])
        per = materialize(per, "nb_words")
        near = per.where(F.col("_word").isNull()).select(key, *carry, *sums)
        far = per.where(F.col("_word").isNotNull()).select(key, F.col("_word").alias("token"), "_n").join(side, "token")
        far = far.groupBy(key).agg(*[F.sum(F.col("logp")[i] * F.col("_n")).alias(f"_c{s}") for i, s in enumerate(sums)])
        total = [(F.coalesce(F.col(s), F.lit(0.0)) + F.coalesce(F.col(f"_c{s}"), F.lit(0.0))).alias(s) for s in sums]
        return near.join(far, key, "left").select(key, *carry, *total)


def fit_naive_bayes(df: DataFrame, tokens_col: str = "tokens", label_col: str = "label_id",
                    labels: list[str] | None = None, alpha: float = 1.0, checkpoint: bool = True) -> NaiveBayesModel:
    """Fit on rows ``(tokens array<string>, label_id int)``; ``labels`` names the ids 0..L-1."""
    lab = F.col(label_col).cast("int")
    docs = {int(r[0]): int(r[1]) for r in df.groupBy(lab).agg(F.count(F.lit(1))).collect()}  # L rows
    ids = sorted(docs) if labels is None else list(range(len(labels)))
    labels = [str(i) for i in ids] if labels is None else labels
    n_docs = sum(docs.values())
    n = [f"_n{i}" for i in ids]
    cnt = df.select(lab.alias("label_id"), F.explode(tokens_col).alias("token")).groupBy("token").agg(
        *[F.count_if(F.col("label_id") == i).alias(c) for i, c in zip(ids, n, strict=True)])
    if checkpoint:
        cnt = materialize(cnt, "nb_counts")
    v, token_bytes, *totals = cnt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)), *[
        F.coalesce(F.sum(c), F.lit(0)) for c in n]).first()
    logp = F.array(*[F.log((F.col(c) + F.lit(alpha)) / F.lit(t + alpha * v)) for c, t in zip(n, totals, strict=True)])
    priors = [math.log(docs.get(i, 0) / n_docs) if docs.get(i, 0) else float("-inf") for i in ids]
    return NaiveBayesModel(labels, priors, cnt.select("token", logp.alias("logp")), int(v), alpha, int(token_bytes))
