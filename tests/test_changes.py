"""S5 + S7: changes by keyed state: only changed files are scanned again."""

from datetime import datetime, timedelta

from vulnscan.plans import jobs
from vulnscan.session import scratch_path
from vulnscan.streaming import changes as CH

START = datetime(2024, 5, 1, 12, 0, 0)


def _code(i, version=0):
    return f"class A{i} {{ public int M{i}() {{ strcpy(a, b{version}); return {version}; }} }}"


def test_change_repeat_deletion_return_and_restart(spark):
    folder, sink, ckpt = (scratch_path(spark, n) for n in ("snapshots", "changes", "changes-ckpt"))

    def step(n, files):
        rows = spark.createDataFrame(sorted(files.items()), "path string, code string")
        CH.append_snapshot(rows, folder, START + timedelta(hours=n))
        before = {b for (b,) in CH.change_log(spark, sink).select("batch_id").distinct().collect()} if n else set()
        # every call starts a new query from the checkpoint
        log = CH.run_change_scan(spark, folder, sink, ckpt).collect()
        return sorted((r.path, r.change) for r in log if r.batch_id not in before)

    files = {f"f{i}": _code(i) for i in range(6)}
    assert step(0, files) == [(f"f{i}", "added") for i in range(6)]
    assert step(1, files) == []
    later = {**files, "f1": _code(1, 2), "f9": _code(9)}
    del later["f4"]
    assert step(2, later) == [("f1", "changed"), ("f4", "deleted"), ("f9", "added")]
    assert step(3, {**later, "f4": files["f4"], "f5": None}) == [("f4", "added"), ("f5", "changed")]

    scanned = [r.path for r in spark.read.parquet(f"{sink}/scans").select("path", "batch_id").distinct().collect()]
    assert sorted(scanned) == ["f0", "f1", "f1", "f2", "f3", "f4", "f4", "f5", "f9"]
    now = spark.createDataFrame(sorted((p, c) for p, c in {**later, "f4": files["f4"]}.items() if p != "f5"), "path string, code string")
    want = jobs.scan_files(now, key="path")
    live = CH.live_scans(spark, sink).select(*want.columns)
    assert sorted(map(repr, live.collect())) == sorted(map(repr, want.collect()))


def test_snapshots_of_one_batch_give_the_net_change(spark):
    folder, sink, ckpt = (scratch_path(spark, n) for n in ("snapshots", "changes", "changes-ckpt"))
    for n, rows in enumerate([[("a", "x"), ("b", "x"), (None, "x")], [("a", "y"), ("a", "y")]]):
        CH.append_snapshot(spark.createDataFrame(rows, "path string, code string"), folder, START + timedelta(hours=n))
    log = CH.run_change_scan(spark, folder, sink, ckpt).collect()
    assert sorted((r.path, r.change, r.code) for r in log) == [("a", "added", "y"), ("b", "added", "x"), ("b", "deleted", None)]


def test_late_rows_grace_and_a_retried_batch(spark):
    folder, sink, ckpt = (scratch_path(spark, n) for n in ("snapshots", "changes", "changes-ckpt"))

    def step(hours, rows):
        CH.append_snapshot(spark.createDataFrame(rows, "path string, code string"), folder, START + timedelta(hours=hours))
        log = CH.run_change_scan(spark, folder, sink, ckpt, "1 hour 30 minutes").collect()
        last = max(r.batch_id for r in log)
        return last, sorted((r.path, r.change, r.code) for r in log if r.batch_id == last)

    assert step(0, [("a", "x"), ("b", "x"), ("c", None)])[1] == [("a", "added", "x"), ("b", "added", "x"), ("c", "added", None)]
    batch, log = step(1, [("a", "y")])
    assert log == [("a", "changed", "y")]
    assert step(2, [("a", "y"), ("d", "x")])[1] == [("b", "deleted", None), ("c", "deleted", None), ("d", "added", "x")]
    # the watermark is at 0:30 now: the first snapshot is late, the second is not, but not newer than what is known
    assert step(0.25, [("e", "x")])[0] == batch + 1
    assert step(0.75, [("e", "x"), ("a", "z")])[1] == [("a", "changed", "z"), ("e", "added", "x")]
    assert step(3, [("a", "z")])[1] == [("e", "deleted", None)]
    assert {(r.path, r.at_ms % 3_600_000) for r in CH.change_log(spark, sink).filter("path = 'a'").collect()} == {("a", 0)}

    # the last batch again, as after a failure before its commit
    before = sorted(map(repr, CH.change_log(spark, sink).collect()))
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits")
    fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in fs.listStatus(commits) if f.getPath().getName().isdigit())
    for name in (f"{last}", f".{last}.crc"):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/{name}"), False)
    assert sorted(map(repr, CH.run_change_scan(spark, folder, sink, ckpt, "1 hour 30 minutes").collect())) == before


def test_no_python_per_path(spark):
    rows = spark.createDataFrame([("a", "x", START)], CH.SNAPSHOT)
    state = CH.track_versions(rows, spark.createDataFrame([], CH.STATE))
    for df in (state, CH.file_changes(rows, state)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan.replace("PythonRDD", "")
    assert state.count() == 1
