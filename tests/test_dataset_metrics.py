"""X1-X5 (dedup, exact split) and G1-G10 (metrics, gates)."""

import math

from pyspark.sql import functions as F

from models import confusion, prf
from vulnscan.operators import dataset as X
from vulnscan.operators import metrics as G
from vulnscan.operators import scoring as C


def _snips(spark, n, dup_every=5):
    rows = [(f"code {i}\nline", i % 2, None if i % 3 == 0 else f"CWE-{i % 7}") for i in range(n)]
    rows += [rows[i] for i in range(0, n, dup_every)]
    return spark.createDataFrame(rows, "Snippet string, Target int, CWE string")


def test_dedup_keeps_nulls_equal(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", 1, "x")], "Snippet string, Target int, CWE string")
    assert X.drop_duplicates(df).count() == 2
    d = X.duplicate_rows(df).collect()
    assert len(d) == 1


def test_split_sizes_exact_and_disjoint(spark):
    for n in (1, 2, 7, 10, 399, 1001):
        df = X.prepare_dataset(_snips(spark, n))
        got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
        tr, te, va = X.expected_sizes(n)
        assert (got.get("train", 0), got.get("test", 0), got.get("val", 0)) == (tr, te, va), n
        assert df.select("row_id").distinct().count() == n
        ranks = sorted(r.rnk for r in df.select("rnk").collect())
        assert ranks == list(range(n))


def test_split_sizes_python():
    assert X.expected_sizes(10) == (7, 1, 2)
    assert X.expected_sizes(399) == (279, 60, 60)
    n = 1001
    hold = math.ceil(0.3 * n)
    assert sum(X.expected_sizes(n)) == n and X.expected_sizes(n)[0] == n - hold


def test_split_stable_across_partitioning(spark):
    base = _snips(spark, 300)
    a = {r.row_id: r.split for r in X.prepare_dataset(base.repartition(1)).collect()}
    b = {r.row_id: r.split for r in X.prepare_dataset(base.repartition(13)).collect()}
    assert a == b


def test_split_hash_is_row_local(spark):
    df = X.split_hash(X.drop_duplicates(_snips(spark, 200)))
    assert df.filter(F.col("split").isNull()).count() == 0
    assert {r.split for r in df.select("split").distinct().collect()} <= {"train", "test", "val"}


def test_confusion_and_scores(spark):
    cases = [
        ([0, 1, 1, 0, 1], [0, 1, 0, 1, 1]),
        ([0, 0, 0], [0, 0, 0]),  # no positives, no predictions
        ([1, 1], [1, 1]),  # one class only
    ]
    for labels, preds in cases:
        df = spark.createDataFrame(list(zip(labels, preds)), "label int, pred int")
        r = G.precision_recall_f1(df).first()
        tn, fp, fn, tp = confusion(labels, preds)
        assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp)
        p, rc, f = prf(tn, fp, fn, tp)
        assert math.isclose(r.precision, p) and math.isclose(r.recall, rc) and math.isclose(r.f1, f)
    empty = spark.createDataFrame([], "label int, pred int")
    r = G.confusion_counts(empty).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 0, 0)


def test_threshold_is_strict_and_nan_safe(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (float("nan"),), (None,), (0.2,)], "p1 double")
    assert [r.f for r in df.select(C.threshold_flag(F.col("p1")).alias("f")).collect()] == [0, 1, 0, 0, 0]


def test_quality_gate(spark):
    rep = spark.createDataFrame([(0.8,), (0.81,)], "test_f1 double")
    assert [r.passed for r in rep.select(G.passes_gate(F.col("test_f1")).alias("passed")).collect()] == [False, True]


def test_softmax_and_loss(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1), (0.0, -3.0, 0), (1000.0, 0.0, 1)], "l0 double, l1 double, y int")
    out = df.select(
        C.softmax_p1(F.col("l0"), F.col("l1")).alias("p1"), C.row_log_loss(F.col("l0"), F.col("l1"), F.col("y")).alias("ls")
    ).collect()
    for (l0, l1, y), r in zip([(0.0, 2.0, 1), (0.0, -3.0, 0), (1000.0, 0.0, 1)], out):
        m = max(l0, l1)
        p1 = math.exp(l1 - m) / (math.exp(l0 - m) + math.exp(l1 - m))
        lse = m + math.log(math.exp(l0 - m) + math.exp(l1 - m))
        assert math.isclose(r.p1, p1, abs_tol=1e-12)
        assert math.isclose(r.ls, lse - (l1 if y == 1 else l0), rel_tol=1e-12)


def test_flag_gate_keeps_files_without_methods(spark):
    from vulnscan.operators import metrics as G

    files = spark.createDataFrame([(1,), (2,)], "doc_id long")
    found = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, vulnerable int")
    assert sorted(tuple(r) for r in G.flag_count_gate(files, found).collect()) == [(1, 1, True), (2, 0, False)]


def test_every_snippet_row_is_scored(spark):
    from vulnscan.plans import jobs as P

    rows = [("int x;", 1, None)] * 3 + [("null", 0, "CWE-1")]
    got = P.score_snippets(spark.createDataFrame(rows, "Snippet string, Target int, CWE string")).collect()
    assert len(got) == 4 and len({r.row_id for r in got}) == 2


def test_row_hash_tells_nulls_and_separators_apart(spark):
    from vulnscan.operators import dataset as X

    rows = [("a", "b"), ("a\x1fb", ""), ("a", None), ("a", "\x1e"), (None, "a"), ("-", "a"), ("1:a", ""), ("", "1:a")]
    df = spark.createDataFrame(rows, "x string, y string").select(X.row_hash(["x", "y"]).alias("h"))
    assert df.distinct().count() == len(rows)


def test_prepare_dataset_keeps_extra_columns_and_their_differences(spark):
    from vulnscan.operators import dataset as X

    rows = [("s", 1, None, "f1"), ("s", 1, None, "f2"), ("s", 1, None, "f2")]
    ds = X.prepare_dataset(spark.createDataFrame(rows, "Snippet string, Target int, CWE string, file string"))
    assert sorted(r.file for r in ds.collect()) == ["f1", "f2"]
