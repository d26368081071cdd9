"""CSV round trip keeps text exactly; split sink prunes; manifest."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from vulnscan.operators import dataset as X
from vulnscan.plans.registry import QUERIES
from vulnscan.session import scratch_path
from vulnscan.sources import io as S

DATA = os.path.join(os.path.dirname(__file__), "data")


def test_csv_round_trip_keeps_whitespace_quotes_and_line_breaks(spark):
    vals = [('  lead\r\n\tmid "q", x\r\n', 1, None), ("b\n\n", 0, "CWE-1"), ('"', 1, "CWE-2")]
    df = spark.createDataFrame(vals, "Snippet string, Target int, CWE string")
    path = scratch_path(spark, "csv")
    S.write_snippets_csv(df, path)
    assert sorted(tuple(r) for r in S.read_snippets(spark, path).collect()) == sorted(vals)


def test_split_sink_and_partition_pruning(spark):
    rows = [(f"s{i}", i % 2, None) for i in range(50)]
    ds = X.prepare_dataset(spark.createDataFrame(rows, "Snippet string, Target int, CWE string"))
    path = scratch_path(spark, "splits")
    S.write_splits(ds, path)
    local = path.removeprefix("file:")
    assert sorted(d for d in os.listdir(local) if d.startswith("split=")) == ["split=test", "split=train", "split=val"]
    test = S.read_split(spark, path, "test")
    assert test.count() == X.expected_sizes(50)[1]
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_manifest_md5_and_size(spark):
    raw = S.read_code_bytes(spark, DATA, glob="*.cs")
    got = {os.path.basename(r.path): (r.md5, r.size) for r in S.file_manifest(raw).collect()}
    for name in ("four_methods.cs", "bare_block.cs"):
        b = open(os.path.join(DATA, name), "rb").read()
        assert got[name] == (hashlib.md5(b).hexdigest(), len(b))
    mism = S.manifest_mismatches(
        S.file_manifest(raw), S.file_manifest(raw).withColumn("md5", F.lit("0" * 32))
    )
    assert mism.count() == 2


def test_snippets_are_read_by_name_and_keep_other_columns(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text('id,Target,Snippet,CWE\n7,1,"int x;",CWE-79\n8,0,"a\nb",\n')
    rows = S.read_snippets(spark, str(f)).collect()
    assert [tuple(r) for r in rows] == [("int x;", 1, "CWE-79", "7"), ("a\nb", 0, None, "8")]
    assert rows[0].asDict()["id"] == "7"
    f.write_text("id,Target,CWE\n7,1,x\n")
    with pytest.raises(ValueError, match="Snippet"):
        S.read_snippets(spark, str(f))


def test_code_files_share_folders_and_keep_every_row(spark):
    """A folder a file makes writing and listing slow; the key lies in the file's name."""
    rows = [(i, f"c{i}\r\n﻿") for i in range(2500)] + [(7, "again"), (-3, None), (None, "no key")]
    files = spark.createDataFrame(rows, "doc_id long, code string")
    path = scratch_path(spark, "shared-folders")
    S.write_code_files(files, path)
    S.write_code_files(files, path)  # takes the place of the first
    local = path.removeprefix("file:")
    folders = [d for d, _, names in os.walk(local) if names]
    assert len(folders) <= 20 and max(len(os.listdir(d)) for d in folders) <= S.FOLDER_FILES
    key = S.file_key().cast("bigint").alias("doc_id")
    got = {r.doc_id: r.code for r in S.read_code_files(spark, path).select(key, "code").collect()}
    expected = {i: c + "\n" for i, c in rows[:2500]} | {-3: "\n", None: "no key\n"}
    assert sorted(got.pop(7).split("\n")) == sorted((expected.pop(7) + "again\n").split("\n"))
    assert got == expected
    raw = S.read_code_bytes(spark, path)
    assert raw.select(key, "content").count() == raw.select(key).distinct().count() == 2502


def test_file_key_is_read_from_folders_too(spark):
    paths = ["file:/a/doc_id=5/part-0.txt", "file:/a/folder=t0-0/doc_id=-6.txt", "file:/a/doc_id=__HIVE_DEFAULT_PARTITION__/part-0.txt", "file:/a/b.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", S.file_key().alias("k"))
    assert [r.k for r in df.collect()] == ["5", "-6", None, None]
    assert S.local_path("file:///a/b") == S.local_path("file:/a/b") == "/a/b"
    assert [S.local_path(p) for p in ("/a/b", "hdfs://h/a", "file://h/a")] == [None] * 3


def test_folders_are_listed_and_read_by_tasks(spark):
    """Spark's file index holds every file in the driver and gives a task few of them."""
    odd = ("a b", "k=%2F%20\u00fc", ".hidden", "_hidden", "_shown=1", "x#?y[1]", "\u00a0n~!$&'()*+,;@\u2003")
    path = scratch_path(spark, "odd-names")
    local = path.removeprefix("file:")
    for i in range(3):
        os.makedirs(f"{local}/folder=t0-{i}")
    for name in odd:
        with open(f"{local}/folder=t0-1/{name}.txt", "wb") as f:
            f.write(name.encode() + b"\xff\r\n")
    open(f"{local}/folder=t0-0/empty.txt", "wb").close()
    with open(f"{local}/folder=t0-2/other.md", "wb") as f:
        f.write(b"md")
    texts, raw = S.read_code_files(spark, path), S.read_code_bytes(spark, path)
    for df in (texts, raw):
        plan = df._jdf.queryExecution()
        assert "FileScan" not in plan.executedPlan().toString() and df.rdd.getNumPartitions() <= 3
        # a size that is not known is taken for a large one: no broadcast of the files
        assert plan.optimizedPlan().stats().sizeInBytes() > 1 << 40
    own = spark.read.format("text").option("wholetext", True).load(path)
    own = own.select("_metadata.file_path", F.hex(F.col("value").cast("binary")), "folder")
    got = texts.select("path", F.hex(F.col("code").cast("binary")), "folder")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect()))
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(*raw.columns)
    assert sorted(map(tuple, raw.collect())) == sorted(map(tuple, own.collect()))
    assert raw.columns == ["path", "content", "length", "folder"] and raw.count() == 5


def test_other_layouts_are_read_by_spark(spark, tmp_path):
    """only the folders of write_code_files are read in another way."""
    (tmp_path / "folder=t0-0").mkdir()
    (tmp_path / "folder=t0-0" / "a.txt").write_text("a")
    assert S.written_folders(f"file:{tmp_path}/") == [f"{tmp_path}/folder=t0-0"]
    assert S.written_folders(str(tmp_path)) is None
    (tmp_path / "folder=x").mkdir()
    (tmp_path / "folder=x" / "b.txt").write_text("b")
    assert S.written_folders(f"file:{tmp_path}") is None
    got = S.read_code_files(spark, f"file:{tmp_path}").select("folder", "code").collect()
    assert sorted(map(tuple, got)) == [("t0-0", "a"), ("x", "b")]


def test_a_folder_among_code_files_is_an_error(spark, tmp_path):
    (tmp_path / "folder=t0-0" / "sub").mkdir(parents=True)
    with pytest.raises(Exception, match="a folder among code files"):
        S.read_code_files(spark, f"file:{tmp_path}").collect()


def test_a_compared_manifest_is_read_once(spark):
    """both sides of the comparison are made of the same files."""
    plan = QUERIES["manifest_compare"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" not in plan and "MapInArrow" not in plan
    assert plan.count("FileScan parquet") == 2
