"""End-to-end: entry(), DuckDB oracles at sf0.001, stream = batch, plan shape."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from paths import SF_SMALL
from vulnscan.plans import fixtures as fx
from vulnscan.plans import jobs as P
from vulnscan.plans.registry import QUERIES
from vulnscan.session import TABLES, scratch_path
from vulnscan.sources import io as S
from vulnscan.streaming import scan_stream as ST


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "method_idx", "name", "method", "p1", "vulnerable", "vul_lines"]
    rows = df.collect()
    from vulnscan.plans.oracle import EXTRA_MEMBERS

    ids = [r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = sorted((i, n) for i in ids if i % 7 != 3 for n in ("Bad", "Good", *EXTRA_MEMBERS[i % len(EXTRA_MEMBERS)][1]))
    assert sorted((r.doc_id, r.name) for r in rows) == want


@pytest.mark.parametrize(
    "name",
    ["strip_comments", "extract_methods", "brace_pairs", "file_verdict", "scan_files", "line_scores",
     "top_lines", "split_exact", "evaluate_test", "build_vocab", "report_long", "score_batch_udf"],
)
def test_oracle_matches(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == _sorted_rows(dcols, res.fetchall())


def test_the_scan_copies_no_text_with_every_token(spark):
    """A first() of the method's text is copied with each token row of the method."""
    files = spark.createDataFrame([(1, "class A { void M() { int x; } }")], "doc_id long, code string")
    for df in (P.scan_files(files), P.scan_files(files, line_level=False), P.scan_lines(files)):
        assert "first(_head" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_equals_batch(spark):
    files = fx.code_files(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src")
    S.write_code_files(files, src)
    streamed = ST.run_scan_stream(spark, src, scratch_path(spark, "sink"), scratch_path(spark, "ckpt"))
    cols = ["doc_id", "method_idx", "name", "p1", "vulnerable", "vul_lines"]
    # the text sink appends one "\n" to each file; it falls outside every method
    batch = P.scan_files(files)
    a = sorted(tuple(r) for r in _by_doc(streamed).select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b


def _by_doc(streamed):
    """The stream's key is the file's path; here its folder names the document."""
    return streamed.withColumn("doc_id", F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_plan_stays_in_jvm_and_partitioned(spark):
    plan = _plan(P.scan_files(fx.code_files(spark, SF_SMALL)))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == plan.count("BroadcastHashJoin") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_parquet_scan_prunes_columns(spark):
    plan = _plan(E.queries()["line_scores"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("ReadSchema: struct<doc_id:bigint,text:string>" in s for s in scans)


# Queries that write or train while being built; their plans are checked elsewhere.
_EAGER = {
    "src_code_files", "file_manifest", "decode_utf8", "src_csv_roundtrip", "src_csv_blocks", "sink_splits",
    "stream_scan", "scan_changed_files", "train_classifier", "train_and_eval", "model_roundtrip", "fit_history", "fit_predict",
}


def test_every_plan_stays_in_jvm_without_pair_joins(spark):
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
    for name, q in sorted(QUERIES.items()):
        if name in _EAGER:
            continue
        plan = _plan(q(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        if name not in ("score_batch_udf", "scan_model"):
            assert not any(p in plan for p in python_nodes), name


def test_text_functions_are_map_only(spark):
    names = ["strip_comments", "drop_cr_tab", "nonblank_lines", "clean_single_line", "clean_multi_line", "add_line_delimiters",
             "tokenize_code", "truncate_tokens", "with_markers", "score_batch_udf"]
    for name in names:
        assert "Exchange" not in _plan(E.queries()[name](spark, SF_SMALL)), name


def test_row_level_queries_have_no_single_partition_exchange(spark):
    for name in ("extract_methods", "file_verdict", "line_scores", "top_lines", "line_scores_split", "top_lines_split"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "SinglePartition" not in plan, name


def test_stream_takes_any_path(spark, tmp_path):
    (tmp_path / "Foo.cs").write_text("class C { int F() { return 1; } }")
    out = ST.run_scan_stream(spark, str(tmp_path), scratch_path(spark, "any"), scratch_path(spark, "any-ckpt")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.name) for r in out] == [("Foo.cs", "F")]


def test_stream_in_several_batches_equals_batch(spark):
    files = fx.code_files(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src-multi")
    S.write_code_files(files, src)
    sink = scratch_path(spark, "sink-multi")
    streamed = ST.run_scan_stream(spark, src, sink, scratch_path(spark, "ckpt-multi"), max_files_per_trigger=50)
    n_batches = streamed.select("batch_id").distinct().count()
    assert n_batches >= 4
    cols = ["doc_id", "method_idx", "name", "p1", "vulnerable", "vul_lines"]
    a = sorted(tuple(r) for r in _by_doc(streamed).select(*cols).collect())
    b = sorted(tuple(r) for r in P.scan_files(files).select(*cols).collect())
    assert a == b
