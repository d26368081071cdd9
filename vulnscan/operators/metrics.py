"""Metrics and gates (G1-G10): one-pass aggregations.

Counts are partial aggregates (map-side), so the only data that moves is one
row per task. Empty input and one-class input give zeros instead of an error;
0/0 gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import QUALITY_F1, THRESHOLD
from ..session import cut_lineage
from .features import running_sums


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """G1: one row (tn, fp, fn, tp); positive class is 1."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        _count_if((y != 1) & (p != 1)).alias("tn"),
        _count_if((y != 1) & (p == 1)).alias("fp"),
        _count_if((y == 1) & (p != 1)).alias("fn"),
        _count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    """G2."""
    return _div(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    """G3."""
    return _div(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """``2tp / (2tp + fp + fn)``."""
    return _div(2 * tp, 2 * tp + fp + fn)


def precision_recall_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """G1-G4 in one row."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        "tn", "fp", "fn", "tp",
        precision(tp, fp).alias("precision"),
        recall(tp, fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"),
    )


def report(
    scored: DataFrame, prefix: str, label: str = "label", pred: str = "pred", loss: str = "loss",
    threshold: float = THRESHOLD, with_counts: bool = False,
) -> DataFrame:
    """G5 (``prefix='eval'``) / G6 (``prefix='test'``, ``with_counts``):
    recall, precision, f1, threshold, loss (a SUM of per-row losses, C6)."""
    y, p = F.col(label), F.col(pred)
    c = scored.agg(
        _count_if((y != 1) & (p != 1)).alias("TN"),
        _count_if((y != 1) & (p == 1)).alias("FP"),
        _count_if((y == 1) & (p != 1)).alias("FN"),
        _count_if((y == 1) & (p == 1)).alias("TP"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("loss_sum"),
    )
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    cols = [
        recall(tp, fn).alias(f"{prefix}_recall"),
        precision(tp, fp).alias(f"{prefix}_precision"),
        f1(tp, fp, fn).alias(f"{prefix}_f1"),
        F.lit(float(threshold)).alias(f"{prefix}_threshold"),
        F.round("loss_sum", 6).alias(f"{prefix}_loss"),
    ]
    if with_counts:
        cols += ["TP", "FP", "TN", "FN"]
    return c.select(*cols)


def report_long(rep: DataFrame, digits: int = 4) -> DataFrame:
    """(key, value) rows, keys sorted, values rounded like the printout."""
    keys = sorted(rep.columns)
    pairs = ", ".join(f"'{k}', cast(`{k}` as double)" for k in keys)
    long = rep.selectExpr(f"stack({len(keys)}, {pairs}) as (key, value)")
    return long.select("key", F.round("value", digits).alias("value")).orderBy("key")


def passes_gate(f1_value: Column, min_f1: float = QUALITY_F1) -> Column:
    """G8 as a column: F1 strictly above the bar."""
    return f1_value > F.lit(min_f1)


def quality_gate(rep: DataFrame, f1_col: str = "test_f1", min_f1: float = QUALITY_F1) -> DataFrame:
    """F1 strictly above the bar."""
    return rep.select(F.col(f1_col), passes_gate(F.col(f1_col), min_f1).alias("passed"))


def flag_count_gate(files: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flagged methods per file and whether there is any; files without methods
    have none."""
    flagged = results.groupBy(key).agg(F.sum("vulnerable").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return files.select(key).join(flagged, key, "left").select(key, n.alias("n_flagged"), (n > 0).alias("has_vulnerable"))


def join_preds_labels(preds: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pair each prediction with its label by id (not by position)."""
    return preds.join(labels, key)


def threshold_curve(df: DataFrame, p: str = "p1", label: str = "label") -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) for every cut that changes a verdict:
    each distinct score as a threshold (rows above it are flagged, strictly), and the one
    below all scores, ``-inf``. Rows with a null or NaN score are never flagged.

    Rows are counted by score first, so ties are one row; the counts above a score are
    prefix sums over a range-partitioned order, not a window over all rows."""
    y = F.when(F.col(label) == 1, 1).otherwise(0)
    score = F.when(~F.isnan(F.col(p).cast("double")), F.col(p).cast("double"))
    counts = df.groupBy(score.alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("pos"))
    counts = cut_lineage(counts)
    total = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("threshold").isNotNull(), F.col("pos"))), F.lit(0)),
                       F.coalesce(F.sum(F.when(F.col("threshold").isNotNull(), F.col("n"))), F.lit(0))).first()
    upto = running_sums(counts.filter("threshold is not null"), [F.asc("threshold")], ["n", "pos"])
    lowest = df.sparkSession.createDataFrame([(float("-inf"), 0, 0)], "threshold double, n_upto long, pos_upto long")
    cuts = lowest.unionByName(upto.select("threshold", "n_upto", "pos_upto"))
    every, with_score, rows = (F.lit(int(x)) for x in total)
    tp = (with_score - F.col("pos_upto")).cast("bigint")
    fp = (rows - F.col("n_upto")).cast("bigint") - tp
    cuts = cuts.select("threshold", tp.alias("tp"), fp.alias("fp"), (every - tp).cast("bigint").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cuts.select("*", precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def best_threshold(df: DataFrame, p: str = "p1", label: str = "label") -> DataFrame:
    """One row of ``threshold_curve``: the cut with the best F1 (ties: the greatest threshold)."""
    curve = threshold_curve(df, p, label)
    return curve.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)
