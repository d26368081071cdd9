"""End-to-end jobs (E1-E5) and result views.

E1 (scan files) plan: files are hash-partitioned by file key once. Everything after that
is one pass over the methods of a file in the task that holds it: extraction, tokens,
scores, verdict, and the ranked lines of flagged methods, which are array expressions of
the method's own row. Scores come from a table of token weights (joined to the token
rows, gathered again by method) or from a caller's batch model, which also gives the
token scores that rank the lines. No checkpoint, no self-join, no further exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FIXED_BIAS, THRESHOLD, TOP_LINES
from ..functions.text import clean_multi_line
from ..operators.attribution import array_top_lines, is_separator
from ..operators.dataset import prepare_dataset, project_snippets, row_hash, select_split
from ..operators.features import tokenize_code, with_markers
from ..operators.fitting import fit_epochs
from ..operators.methods import extract_methods
from ..operators.metrics import passes_gate, report
from ..operators.scoring import (
    apply_model,
    fixed_weights,
    row_log_loss,
    softmax_p1,
    threshold_flag,
    token_weights,
    train_classifier,
)
from ..session import cut_lineage


def scan_files(
    files: DataFrame,
    key: str = "doc_id",
    weights: DataFrame | None = None,
    bias: float = FIXED_BIAS,
    threshold: float = THRESHOLD,
    line_level: bool = True,
    top_k: int = TOP_LINES,
    model: Callable[[Column], Column] | None = None,
    literal_safe: bool = False,
    symbols: Collection[str] | None = None,
) -> DataFrame:
    """(key, method_idx, name, method, p1, vulnerable[, vul_lines]).

    ``vul_lines`` holds up to ``top_k`` line indices (comma-joined, in rank
    order) for flagged methods and NULL (the ``[None]`` of the original) for
    the others. ``model`` (``scoring.sequence_scorer``) takes the place of the weight
    table. ``literal_safe`` and ``symbols`` are those of ``extract_methods``.
    """
    cols = [key, "method_idx", "name", "method", "p1", "vulnerable"]
    scored = _scored_methods(files, key, weights, bias, threshold, model, line_level, literal_safe=literal_safe, symbols=symbols)
    if not line_level:
        return scored.select(*cols)
    top = F.transform(array_top_lines(F.col("_scored"), top_k), lambda x: x["line_idx"].cast("string"))
    return scored.select(*cols, F.when(F.col("vulnerable") == 1, F.array_join(top, ",")).alias("vul_lines"))


def _scored_methods(files, key, weights, bias, threshold, model=None, line_level=True, **reading) -> DataFrame:
    """Methods with p1, verdict and, for ``line_level``, their tokens as (sep, score)."""
    keys = [key, "method_idx"]
    seq = with_markers(tokenize_code(clean_multi_line("method")))
    methods = extract_methods(files, key, **reading).select(*keys, "name", "method", seq.alias("_toks"))
    if model is not None:
        rows = methods.select("*", model(F.col("_toks")).alias("_out"))
        p1 = F.col("_out.p1")
        pairs = F.transform(F.arrays_zip("_toks", "_out.scores"), lambda x: F.struct(is_separator(x["_toks"]).alias("sep"), x["scores"].alias("score")))
    else:
        weights = weights if weights is not None else fixed_weights(files.sparkSession)
        # the outer form: every method has its two markers, and a plain explode would
        # repeat the tokenizing expression in an inferred filter
        tokens = methods.select(*keys, "name", "method", F.posexplode_outer("_toks").alias("pos", "token"))
        # the text goes with one token row only
        head = F.when(F.col("pos") == 0, F.struct("name", "method")).alias("_head")
        tokens = token_weights(tokens.select(*keys, "pos", "token", head), weights)
        # a list of one: the buffer of first() is copied, text and all, with every token row
        parts = [F.sum("w").alias("_z"), F.get(F.collect_list("_head"), F.lit(0)).alias("_head")]
        if line_level:
            score = F.greatest(F.col("w"), F.lit(0.0))
            parts.append(F.collect_list(F.struct("pos", is_separator(F.col("token")).alias("sep"), score.alias("score"))).alias("_pairs"))
        rows = tokens.groupBy(*keys).agg(*parts).select("*", "_head.name", "_head.method")
        p1 = softmax_p1(F.lit(0.0), F.col("_z") + F.lit(bias))
        pairs = F.array_sort("_pairs")
    rows = rows.select("*", p1.alias("_p1"))
    flagged = threshold_flag(F.col("_p1"), threshold)
    out = [*keys, "name", "method", F.round("_p1", 6).alias("p1"), flagged.alias("vulnerable")]
    # gate before ranking: only flagged methods keep their tokens
    return rows.select(*out, F.when(flagged == 1, pairs).alias("_scored")) if line_level else rows.select(*out)


def scan_lines(
    files: DataFrame, key: str = "doc_id", weights: DataFrame | None = None, bias: float = FIXED_BIAS,
    threshold: float = THRESHOLD, top_k: int = TOP_LINES, model: Callable[[Column], Column] | None = None,
    literal_safe: bool = False, symbols: Collection[str] | None = None,
) -> DataFrame:
    """E1 by line (Q6, Q11): one row for each of the ``top_k`` lines of a flagged method:
    (key, method_idx, rank, line_no, line, score), ``line_no`` counting the lines of the
    cleaned method from 1."""
    keys = [key, "method_idx"]
    scored = _scored_methods(files, key, weights, bias, threshold, model, literal_safe=literal_safe, symbols=symbols)
    flagged = scored.filter(F.col("vulnerable") == 1).select(
        *keys, F.split(clean_multi_line("method"), "\n").alias("_lines"), array_top_lines(F.col("_scored"), top_k).alias("_top"))
    ranked = flagged.select(*keys, "_lines", F.posexplode("_top").alias("_i", "_x"))
    return ranked.select(
        *keys, (F.col("_i") + 1).cast("bigint").alias("rank"), "_x.line_no",
        F.get("_lines", (F.col("_x.line_no") - 1).cast("int")).alias("line"), "_x.score",
    )


def method_flags(
    files: DataFrame,
    key: str = "doc_id",
    weights: DataFrame | None = None,
    bias: float = FIXED_BIAS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, method_idx, vulnerable) only: the verdict path of E1 without the
    method text. Methods are consumed once, so no checkpoint is needed, and
    extraction, token explode, the per-method sum and a per-file roll-up all
    run on the one partitioning by file key (no further exchange)."""
    weights = weights if weights is not None else fixed_weights(files.sparkSession)
    keys = [key, "method_idx"]
    seq = with_markers(tokenize_code(clean_multi_line("method")))
    tok = extract_methods(files, key).select(*keys, F.explode_outer(seq).alias("token"))
    s = token_weights(tok, weights).groupBy(*keys).agg((F.sum("w") + F.lit(bias)).alias("_logit1"))
    p1 = softmax_p1(F.lit(0.0), F.col("_logit1"))
    return s.select(*keys, threshold_flag(p1, threshold).alias("vulnerable"))


def vulnerable_rows(results: DataFrame) -> DataFrame:
    """The flagged methods only."""
    return results.filter(F.col("vulnerable") == 1)


def file_verdict(files: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """P5: 1 if any method of the file is flagged; files without methods are clean."""
    per_file = results.groupBy(key).agg(F.max("vulnerable").alias("v"))
    return files.select(key).join(per_file, key, "left").select(
        key, F.coalesce("v", F.lit(0)).cast("int").alias("vulnerable")
    )


def score_texts(
    df: DataFrame, keys: list[str], text_col: str, weights: DataFrame | None = None,
    bias: float = FIXED_BIAS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Fixed-weight linear scoring of whole texts: (keys, logit0, logit1, p1, pred)."""
    weights = weights if weights is not None else fixed_weights(df.sparkSession)
    # Outer explode: a text without tokens keeps one row and gets logit1 = bias.
    t = df.select(*keys, F.explode_outer(tokenize_code(clean_multi_line(text_col))).alias("token"))
    s = token_weights(t, weights).groupBy(*keys).agg(F.sum("w").alias("z"))
    l1 = F.col("z") + F.lit(bias)
    return s.select(
        *keys, F.lit(0.0).alias("logit0"), l1.alias("logit1"),
    ).withColumn("p1", softmax_p1(F.col("logit0"), F.col("logit1"))).withColumn(
        "pred", threshold_flag(F.col("p1"), threshold)
    )


def score_snippets(snippets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """E5: every snippet row scored: (row_id, p1, vulnerable). Equal rows have equal ids
    and scores, so each distinct row is scored once and stands as often as given."""
    d = project_snippets(snippets).groupBy("Snippet", "Target", "CWE").agg(F.count(F.lit(1)).alias("_n"))
    d = d.withColumn("row_id", row_hash(["Snippet", "Target", "CWE"]))
    s = score_texts(d, ["row_id", "_n"], "Snippet", threshold=threshold)
    s = s.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return s.select("row_id", F.round("p1", 6).alias("p1"), F.col("pred").alias("vulnerable"))


def _scored_split(snippets: DataFrame, split: str, threshold: float) -> DataFrame:
    ds = select_split(prepare_dataset(snippets, rank=False), split)
    s = score_texts(ds, ["row_id", "Target"], "Snippet", threshold=threshold)
    return s.withColumn("label", F.col("Target")).withColumn(
        "loss", row_log_loss(F.col("logit0"), F.col("logit1"), F.col("label"))
    )


def eval_report(snippets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """G5 on the validation split with the fixed scorer."""
    return report(_scored_split(snippets, "val", threshold), "eval", threshold=threshold)


def test_report(snippets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """G6 on the test split with the fixed scorer."""
    return report(_scored_split(snippets, "test", threshold), "test", threshold=threshold, with_counts=True)


def evaluate_test(snippets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Test report plus the quality gate."""
    rep = test_report(snippets, threshold)
    return rep.withColumn("passed", passes_gate(F.col("test_f1")))


def labelled_tokens(snippets: DataFrame) -> DataFrame:
    """(row_id, split, label, tokens) of the prepared data set, written once."""
    ds = prepare_dataset(snippets, rank=False)
    return cut_lineage(ds.select(
        "row_id", "split", F.col("Target").alias("label"),
        tokenize_code(clean_multi_line("Snippet")).alias("tokens"),
    ))


def train_best(rows: DataFrame):
    """C1 + C7 on the train split, the best by the val split: (model, (alpha, f1))."""
    return train_classifier(select_split(rows, "train"), select_split(rows, "val"), ["row_id"])


def fit_best(rows: DataFrame, **settings):
    """C1 + C7 by gradient descent: (model, history), validated on the val split each epoch."""
    return fit_epochs(select_split(rows, "train"), select_split(rows, "val"), **settings)


def train_and_eval(snippets: DataFrame, threshold: float = THRESHOLD):
    """Train on 'train', keep the best model, report on 'val'. Returns
    (model, report DataFrame)."""
    rows = labelled_tokens(snippets)
    model, _ = train_best(rows)
    val = apply_model(model, select_split(rows, "val"), ["row_id", "label"])
    val = val.withColumn("pred", threshold_flag(F.col("p1"), threshold)).withColumn(
        "loss", row_log_loss(F.col("logit0"), F.col("logit1"), F.col("label"))
    )
    return model, report(val, "eval", threshold=threshold)
