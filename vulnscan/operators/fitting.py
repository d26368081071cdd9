"""Iterative fit with validation each epoch (C1, C7): logistic regression on hashed tokens.

A token falls into one of ``slots`` slots by its md5; a row's features are its slot
counts, scaled to length one. Feature rows are made once and written. An epoch is one
pass over them: each task computes in numpy, from the broadcast weights (``slots``
numbers, a bound set by the caller), its part of the gradient over the training rows and
of the loss and confusion counts over the validation rows; parts are summed by slot in
Spark, partially in each task, and at most ``slots`` sums come back. So no token row is
shuffled, and what the driver holds does not grow with the data.

The weights of the epoch with the best validation F1 are kept (ties: the earliest), and
the fit stops when the validation loss has not been least for ``patience`` epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import THRESHOLD
from ..session import cut_lineage
from .scoring import softmax_p1

SLOTS = 1 << 16
EPOCHS = 20
RATE = 4.0
DECAY = 1e-4
PATIENCE = 3
#: Rows whose features an epoch unfolds at a time; Arrow batches may hold many more.
EPOCH_ROWS = 512


@dataclass
class HashedModel:
    """Weights by slot (only those that are not zero), bias and the epoch they are of."""

    weights: dict[int, float]
    bias: float
    slots: int
    epoch: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(k), float(v)) for k, v in self.weights.items()], "slot int, w double")


def token_slot(token: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def _features(column: pd.Series) -> pd.DataFrame:
    made = []
    for found in column:
        slot, count = np.unique(np.asarray([] if found is None else found, np.int32), return_counts=True)
        # arrays, not lists: a Python number takes up to nine times the room
        made.append((slot, count / max(1.0, np.sqrt((count.astype(float) ** 2).sum()))))
    return pd.DataFrame(made, columns=["slot", "value"])


def hashed_rows(rows: DataFrame, keys: list[str], tokens_col: str = "tokens", slots: int = SLOTS) -> DataFrame:
    """(keys, slot array<int>, value array<double>): the distinct slots of a row with its
    counts over their root sum of squares. A row without tokens has empty arrays."""
    @F.pandas_udf("slot array<int>, value array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from map(_features, batches)

    slots_of = F.transform(tokens_col, lambda t: token_slot(t, slots))
    return rows.select(*keys, features(slots_of).alias("_f")).select(*keys, "_f.slot", "_f.value")


#: Places of the sums that are no slot's: bias gradient, rows and loss of the training
#: rows; rows, loss and confusion counts of the validation rows.
BIAS, TRAIN_ROWS, TRAIN_LOSS, VAL_ROWS, VAL_LOSS, TP, FP, FN = range(-8, 0)


def _epoch(shared, threshold: float):
    """A task's sums (place, total) over feature rows (held, y, slot, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        total = np.zeros(len(w) + 8)  # the last eight by their negative places
        for batch in (whole.slice(at, EPOCH_ROWS) for whole in batches for at in range(0, whole.num_rows, EPOCH_ROWS)):
            held, y = batch.column(0).to_numpy(zero_copy_only=False).astype(bool), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            slot, value = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            of = np.repeat(np.arange(len(y)), sizes)
            z = np.bincount(of, w[slot] * value, len(y)) + bias
            p, loss = 1 / (1 + np.exp(-z)), np.logaddexp(0, z) - y * z
            error = np.where(held, 0.0, p - y)
            total[: len(w)] += np.bincount(slot, error[of] * value, len(w))
            flagged = p > threshold
            for place, x in ((BIAS, error), (TRAIN_ROWS, ~held), (TRAIN_LOSS, np.where(held, 0, loss)), (VAL_ROWS, held), (VAL_LOSS, np.where(held, loss, 0)),
                             (TP, held & flagged & (y == 1)), (FP, held & flagged & (y != 1)), (FN, held & ~flagged & (y == 1))):
                total[place] += x.sum()
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(place >= len(w), place - len(total), place)), pa.array(total[place])], names=["place", "total"])

    return run


def fit_epochs(
    train: DataFrame, val: DataFrame, label_col: str = "label", tokens_col: str = "tokens", slots: int = SLOTS, epochs: int = EPOCHS,
    rate: float = RATE, decay: float = DECAY, patience: int = PATIENCE, threshold: float = THRESHOLD,
) -> tuple[HashedModel, DataFrame]:
    """(kept model, history (epoch, train_loss, val_loss, val_f1, best)). Epoch
    0 is the untrained model. Labels other than 1 count as 0; without training rows the
    model stays untrained."""
    spark = train.sparkSession

    def part(rows: DataFrame, held: bool) -> DataFrame:
        y = F.when(F.col(label_col) == 1, 1).otherwise(0)
        return hashed_rows(rows.select(F.lit(held).alias("held"), y.alias("y"), tokens_col), ["held", "y"], tokens_col, slots)

    rows = cut_lineage(part(train, False).unionByName(part(val, True)))
    w, bias, history, kept, least = np.zeros(slots), 0.0, [], None, (np.inf, 0)
    for epoch in range(epochs + 1):
        shared = spark.sparkContext.broadcast((w, bias))
        sums = rows.mapInArrow(_epoch(shared, threshold), "place long, total double").groupBy("place").agg(F.sum("total").alias("total"))
        got = dict(sums.collect())  # at most ``slots`` and eight
        shared.destroy()
        n, m = max(1.0, got.get(TRAIN_ROWS, 0)), max(1.0, got.get(VAL_ROWS, 0))
        tp, wrong = got.get(TP, 0), got.get(FP, 0) + got.get(FN, 0)
        f1 = 2 * tp / (2 * tp + wrong) if tp else 0.0
        history.append((epoch, got.get(TRAIN_LOSS, 0.0) / n, got.get(VAL_LOSS, 0.0) / m, f1))
        if kept is None or f1 > history[kept.epoch][3]:
            used = np.flatnonzero(w)
            kept = HashedModel(dict(zip(used.tolist(), w[used].tolist(), strict=True)), bias, slots, epoch)
        if history[-1][2] < least[0]:
            least = (history[-1][2], epoch)
        if epoch - least[1] >= patience:
            break
        gradient = np.zeros(slots)
        places = [k for k in got if k >= 0]
        gradient[places] = [got[k] for k in places]
        w, bias = w - rate * (gradient / n + decay * w), bias - rate * got.get(BIAS, 0.0) / n
    table = [(e, float(a), float(b), float(f), e == kept.epoch) for e, a, b, f in history]
    return kept, spark.createDataFrame(table, "epoch int, train_loss double, val_loss double, val_f1 double, best boolean")


def apply_hashed(model: HashedModel, rows: DataFrame, keys: list[str], tokens_col: str = "tokens") -> DataFrame:
    """(keys, logit0, logit1, p1). The weights (at most ``slots``) meet the features in
    the task that holds the row; Spark broadcasts them by their size or shuffles."""
    f = hashed_rows(rows, keys, tokens_col, model.slots)
    f = f.select(*keys, F.explode_outer(F.arrays_zip("slot", "value")).alias("x")).select(*keys, "x.slot", "x.value")
    z = f.join(model.table(rows.sparkSession), "slot", "left").groupBy(*keys).agg(F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0.0)).alias("z"))
    logit = F.col("z") + F.lit(model.bias)
    return z.select(*keys, F.lit(0.0).alias("logit0"), logit.alias("logit1"), softmax_p1(F.lit(0.0), logit).alias("p1"))
