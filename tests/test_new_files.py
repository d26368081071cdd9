"""The stream source of local folders lists a file once and takes whole folders in a task."""

import os
import pickle

import pytest

from vulnscan.session import scratch_path
from vulnscan.streaming import new_files as N
from vulnscan.streaming import scan_stream as ST

CODE = "class C { int %s() { return 1; } }\n"
COLS = ["path", "method_idx", "name", "method", "p1", "vulnerable", "vul_lines"]


@pytest.fixture(scope="module", autouse=True)
def active_session(spark):
    """The batches of a stream leave its own session active, by whichever source; a new frame
    makes this one active again for the tests that follow."""
    yield
    spark.createDataFrame([(0,)], "i int")


def _write(root, name, method):
    file = root / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes((CODE % method).encode() if method else b"")


def _names(reader, start, end):
    return [N._names(p.value) for p in reader.partitions({"segments": start}, {"segments": end})]


def test_parts_are_bounded_and_a_segment_stays_as_it_is(tmp_path, monkeypatch):
    """a task of Spark's file source has a few small files."""
    src, listed = tmp_path / "src", str(tmp_path / "listed")
    for i in range(25):
        _write(src, f"folder=t0-{i % 2}/doc_id={i}.txt", f"M{i}")
    _write(src, "folder=t0-0/.half", "Hidden")
    _write(src, "plain/doc_id=9.txt", "Elsewhere")
    monkeypatch.setattr(N, "PART_FILES", 10)
    reader = N.NewFilesReader(str(src), listed)
    assert reader.initialOffset() == {"segments": 0} and reader.latestOffset() == {"segments": 1} == reader.latestOffset()
    first = _names(reader, 0, 1)
    assert [len(p) for p in first] == [10, 10, 5]
    assert sorted(sum(first, [])) == sorted(f"folder=t0-{i % 2}/doc_id={i}.txt" for i in range(25))
    monkeypatch.setattr(N, "PART_BYTES", 1)
    for i in (25, 26):
        _write(src, f"folder=t0-{i % 2}/doc_id={i}.txt", f"M{i}")
    os.makedirs(f"{listed}/new-of-a-look-that-was-stopped")
    assert len(pickle.dumps(reader)) < 1000 and pickle.loads(pickle.dumps(reader)).seen is None
    again = N.NewFilesReader(str(src), listed)
    assert again.latestOffset() == {"segments": 2} and _names(again, 0, 1) == first
    assert sorted(_names(again, 1, 2)) == [["folder=t0-0/doc_id=26.txt"], ["folder=t0-1/doc_id=25.txt"]]
    rows = [r for p in again.partitions({"segments": 1}, {"segments": 2}) for b in again.read(p) for r in b.to_pylist()]
    assert {r["path"]: r["content"] for r in rows} == {f"file:{src}/folder=t0-{i % 2}/doc_id={i}.txt": (CODE % f"M{i}").encode() for i in (25, 26)}


def test_stream_takes_up_new_files_as_sparks_source_does(spark, tmp_path):
    src = tmp_path / "s r%41c"
    for i, name in enumerate(("folder=t0-0/a.txt", "folder=t0-0/b c%2Fü.txt", "folder=t0-1/doc_id=1.txt")):
        _write(src, name, f"M{i}")
    _write(src, "folder=t0-1/empty.txt", None)
    _write(src, "folder=t0-1/_hidden.txt", "Hidden")

    def runs(name, **kw):
        return ST.run_scan_stream(spark, f"file:{src}", scratch_path(spark, f"sink-{name}"), scratch_path(spark, f"ckpt-{name}"), **kw)

    own = sorted(map(tuple, runs("own").select(*COLS).collect()))
    assert [r[2] for r in own] == ["M0", "M1", "M2"]
    assert own == sorted(map(tuple, runs("sparks", max_files_per_trigger=100).select(*COLS).collect()))

    sink, ckpt = scratch_path(spark, "sink-on"), scratch_path(spark, "ckpt-on")
    ST.run_scan_stream(spark, f"file:{src}", sink, ckpt)
    _write(src, "folder=t0-0/a.txt", "Changed")  # its path has been taken
    _write(src, "folder=t0-0/late.txt", "Late")
    _write(src, "folder=t9-0/new.txt", "New")
    for _ in range(2):  # without new files there is no batch
        rows = ST.run_scan_stream(spark, f"file:{src}", sink, ckpt).select("batch_id", "name").collect()
        assert sorted(map(tuple, rows)) == [(0, "M0"), (0, "M1"), (0, "M2"), (1, "Late"), (1, "New")]


def test_a_checkpoint_stays_with_its_source(spark, tmp_path):
    _write(tmp_path, "folder=t0-0/a.txt", "A")
    src, names = f"file:{tmp_path}", ("sink-a", "ckpt-a", "sink-b", "ckpt-b")
    sink, ckpt, other_sink, other = (scratch_path(spark, n) for n in names)
    ST.run_scan_stream(spark, src, sink, ckpt, max_files_per_trigger=5)
    ST.run_scan_stream(spark, src, other_sink, other)
    _write(tmp_path, "folder=t0-0/b.txt", "B")
    rows = ST.run_scan_stream(spark, src, sink, ckpt).select("batch_id", "name").collect()
    assert sorted(map(tuple, rows)) == [(0, "A"), (1, "B")]
    with pytest.raises(ValueError, match="begun without a limit"):
        ST.run_scan_stream(spark, src, other_sink, other, max_files_per_trigger=5)
