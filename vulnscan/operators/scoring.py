"""Scoring (C1-C7, P3).

C3-C6 are plain column arithmetic over a (token, w) table joined to token
rows; C1 learns such a table in closed form with group-bys (so it has every token
of the training rows, and nothing but a few totals on the driver); C2 runs a
caller-supplied batch model through ``predict_batch_udf`` (Arrow batches, model
built once per Python worker).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import FIXED_BIAS, FIXED_WEIGHTS, THRESHOLD
from ..session import cut_lineage

def token_weights(tokens: DataFrame, weights: DataFrame, token_col: str = "token") -> DataFrame:
    """Adds ``w`` (0 for tokens without a weight). The weight table may be of any size:
    Spark broadcasts it if its measured size allows, else shuffles and splits hot tokens."""
    w = weights.select(F.col("token").alias(token_col), F.col("w"))
    return tokens.join(w, token_col, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def softmax_p1(l0: Column, l1: Column) -> Column:
    """C4: probability of class 1 by a max-shifted softmax over two logits."""
    m = F.greatest(l0, l1)
    e0, e1 = F.exp(l0 - m), F.exp(l1 - m)
    return e1 / (e0 + e1)


def row_log_loss(l0: Column, l1: Column, label: Column) -> Column:
    """Cross-entropy on the logits: log-sum-exp minus the label's logit."""
    m = F.greatest(l0, l1)
    lse = m + F.log(F.exp(l0 - m) + F.exp(l1 - m))
    return lse - F.when(label == 1, l1).otherwise(l0)


def threshold_flag(p1: Column, threshold: float = THRESHOLD) -> Column:
    """1 iff ``p1 > threshold`` (strict); NaN and NULL give 0 (Spark and
    DuckDB order NaN above every number, Python does not)."""
    return F.when((p1 > F.lit(threshold)) & ~F.isnan(p1), 1).otherwise(0).cast("int")


def fixed_weights(spark) -> DataFrame:
    """The fixed table; of so few rows that its joins are broadcast joins from the start."""
    return F.broadcast(spark.createDataFrame(list(FIXED_WEIGHTS), "token string, w double"))


# ---------------------------------------------------------------------------
# Training (C1, C7, S6) and batch inference
# ---------------------------------------------------------------------------

#: Candidate models: naive Bayes smoothings.
ALPHAS = (0.1, 1.0, 10.0)


class Model:
    """A linear scorer: (token, w) table, bias, and the smoothing it came from."""

    def __init__(self, weights: DataFrame, bias: float, alpha: float):
        self.weights, self.bias, self.alpha = weights, bias, alpha


def train_candidates(train: DataFrame, tokens_col: str = "tokens", label_col: str = "label", alphas=ALPHAS):
    """((token, w) with one weight for each smoothing, biases). The weight of a token
    is the difference of its smoothed log frequencies in the two classes."""
    one = F.when(F.col(label_col) == 1, 1).otherwise(0)
    tokens = train.select(one.alias("y"), F.explode_outer(tokens_col).alias("token")).filter(F.col("token").isNotNull())
    counts = tokens.groupBy("token").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    n0, n1, v = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("c0", "c1")], F.count(F.lit(1))).first()
    d1, d = train.agg(F.coalesce(F.sum(one), F.lit(0)), F.count(F.lit(1))).first()

    def weight(a: float) -> Column:
        part = lambda c, n: F.log((F.col(c) + F.lit(a)) / F.lit(n + a * v))
        return part("c1", n1) - part("c0", n0)

    bias = math.log((d1 + 1) / (d - d1 + 1))
    return counts.select("token", F.array(*[weight(a) for a in alphas]).alias("w")), [bias] * len(alphas)


def candidate_logits(rows: DataFrame, keys: list[str], weights: DataFrame, biases: list[float], tokens_col: str = "tokens") -> DataFrame:
    """(keys, z0, z1, ...): the second class's logit by each candidate, in one pass."""
    tokens = rows.select(*keys, F.explode_outer(tokens_col).alias("token"))
    sums = [(F.coalesce(F.sum(F.get("w", F.lit(i))), F.lit(0.0)) + F.lit(b)).alias(f"z{i}") for i, b in enumerate(biases)]
    return tokens.join(weights, "token", "left").groupBy(*keys).agg(*sums)


def candidate_f1(logits: DataFrame, n: int, label_col: str = "label", threshold: float = THRESHOLD) -> list[float]:
    """F1 of each candidate (n numbers)."""
    from .metrics import f1

    columns = []
    for i in range(n):
        p, y = threshold_flag(softmax_p1(F.lit(0.0), F.col(f"z{i}")), threshold), F.col(label_col)
        tp, fp, fn = (F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)) for c in ((y == 1) & (p == 1), (y != 1) & (p == 1), (y == 1) & (p != 1)))
        columns.append(f1(tp, fp, fn).alias(f"f{i}"))
    return list(logits.agg(*columns).first())


def train_classifier(train: DataFrame, val: DataFrame, keys: list[str], label_col: str = "label", alphas=ALPHAS) -> tuple[Model, DataFrame]:
    """Trains the candidates, keeps the one with the best F1 on ``val`` (ties:
    the smallest smoothing). Returns it and (alpha, f1) of the kept one."""
    weights, biases = train_candidates(train, label_col=label_col, alphas=alphas)
    weights = cut_lineage(weights)
    scores = candidate_f1(candidate_logits(val, [*keys, label_col], weights, biases), len(alphas), label_col)
    best = max(range(len(alphas)), key=lambda i: (scores[i], -alphas[i]))
    kept = train.sparkSession.createDataFrame([(float(alphas[best]), float(scores[best]))], "alpha double, f1 double")
    return Model(weights.select("token", F.get("w", F.lit(best)).alias("w")), biases[best], alphas[best]), kept


def apply_model(model: Model, rows: DataFrame, keys: list[str], tokens_col: str = "tokens") -> DataFrame:
    """(keys, logit0, logit1, p1)."""
    tokens = rows.select(*keys, F.explode_outer(tokens_col).alias("token"))
    z = token_weights(tokens, model.weights).groupBy(*keys).agg((F.sum("w") + F.lit(model.bias)).alias("logit1"))
    return z.select(*keys, F.lit(0.0).alias("logit0"), "logit1", softmax_p1(F.lit(0.0), F.col("logit1")).alias("p1"))


def save_model(model: Model, path: str) -> None:
    """One table; the row without token holds the bias."""
    spark = model.weights.sparkSession
    bias = spark.createDataFrame([(None, float(model.bias))], "token string, w double")
    model.weights.unionByName(bias).withColumn("alpha", F.lit(float(model.alpha))).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    table = spark.read.parquet(path)
    bias, alpha = table.filter("token is null").select("w", "alpha").first()
    return Model(table.filter("token is not null").select("token", "w"), bias, alpha)


def batch_scorer(make_predict_fn: Callable, n_features: int, batch_size: int = 1024):
    """Wrap a model factory as an Arrow-batched Spark function.

    ``make_predict_fn()`` is called once per Python worker and must return a
    function ``ndarray[batch, n_features] -> ndarray[batch]`` of p1.
    """
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(
        make_predict_fn,
        return_type=T.DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[n_features]],
    )


def sequence_scorer(make_model: Callable, batch_rows: int = 256) -> Callable[[Column], Column]:
    """C2 for whole token sequences: a Spark function from an array of tokens to
    (p1, scores), with one score for each token (A1: what the model attends to).

    ``make_model()`` is called once per Python task and returns a function from a list of
    token lists to (p1 of each, scores of each); it sees at most ``batch_rows`` lists at a
    time. Lists keep their own lengths; a null array counts as an empty list. A score list
    that is not as long as its tokens is an error, never cut or filled up."""
    @F.pandas_udf("p1 double, scores array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for column in batches:
            p1, scores = [], []
            for at in range(0, len(column), batch_rows):
                tokens = [[] if t is None else list(t) for t in column.iloc[at : at + batch_rows]]
                p, s = model(tokens)
                if [len(x) for x in s] != [len(t) for t in tokens] or len(p) != len(tokens):
                    raise ValueError("the model must give one probability a sequence and one score a token")
                p1 += [float(x) for x in p]
                scores += [[float(y) for y in x] for x in s]
            yield pd.DataFrame({"p1": pd.Series(p1, dtype="float64"), "scores": pd.Series(scores, dtype="object")})

    return scored


def make_numpy_sequence_model(weights=FIXED_WEIGHTS, bias: float = FIXED_BIAS):
    """A numpy model for ``sequence_scorer``: token embeddings of one dimension, a logistic
    head over their sum, and each token's positive share as its score."""
    table = dict(weights)

    def make():
        import numpy as np

        def predict(sequences):
            ends = np.cumsum([len(s) for s in sequences])
            w = np.array([table.get(t, 0.0) for s in sequences for t in s], dtype=np.float64)
            parts = np.split(w, ends[:-1])
            z = np.array([p.sum() for p in parts]) + bias
            return 1.0 / (1.0 + np.exp(-z)), [np.maximum(p, 0.0) for p in parts]

        return predict

    return make


def make_fixed_linear_model(vocab=tuple(t for t, _ in FIXED_WEIGHTS)):
    """A numpy model equal to the fixed linear scorer over token counts."""
    weights = dict(FIXED_WEIGHTS)

    def make():
        import numpy as np

        w = np.array([weights[t] for t in vocab], dtype=np.float64)

        def predict(x):
            z = x.astype(np.float64) @ w + FIXED_BIAS
            return 1.0 / (1.0 + np.exp(-z))

        return predict

    return make


def token_count_features(tokens_col: str, vocab=tuple(t for t, _ in FIXED_WEIGHTS)) -> Column:
    """Counts of each vocabulary token in an array column (JVM side)."""
    def equals(t):
        # one-argument lambda: Spark passes the element index as a second one
        return lambda x: x == F.lit(t)

    return F.array(*[F.size(F.filter(F.col(tokens_col), equals(t))).cast("double") for t in vocab])
