"""S1 by blocks: the rows of ``read_snippets``, wherever blocks are cut."""

import random

import pytest

from vulnscan.session import scratch_path
from vulnscan.sources import csv_blocks as B
from vulnscan.sources import io as S


@pytest.fixture
def block_bytes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_to(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


def _rows(df):
    return sorted(df.collect(), key=repr)


def _texts(seed, n):
    rnd = random.Random(seed)
    parts = ["a", '"', '""', "\n", "\r\n", ",", "int x;", "\n\n", "é", " ", "\t", "long " * 40]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("size", [7, 64, 300, 1 << 20])
def test_same_rows_at_every_block_size(spark, block_bytes, size):
    vals = [(t, i % 2, None if i % 3 else f"CWE-{i}") for i, t in enumerate(_texts(size, 120 if size > 7 else 25))]
    path = scratch_path(spark, "csv")
    S.write_snippets_csv(spark.createDataFrame(vals, "Snippet string, Target int, CWE string").coalesce(2), path)
    want = _rows(S.read_snippets(spark, path))
    block_bytes(size)
    assert _rows(B.read_snippets_blocks(spark, path)) == want


def test_a_record_over_many_blocks_and_plain_lines(spark, block_bytes, tmp_path):
    f = tmp_path / "s.csv"
    long = "x\n" * 500 + '""q""' + "\r\n" * 300
    body = f'id,Target,Snippet,CWE\n7,1,"{long}",CWE-79\n\n8,0,plain,\n9,1,"",x'
    f.write_bytes(body.encode())
    block_bytes(50)
    got = _rows(B.read_snippets_blocks(spark, str(f)))
    assert got == _rows(S.read_snippets(spark, str(f)))
    assert [r.id for r in got if r.Snippet == long.replace('""', '"')] == ["7"]
    assert B.csv_records(spark, str(f)).count() == 4


def test_line_ends_of_crlf_files_are_no_part_of_values(spark, block_bytes, tmp_path):
    f = tmp_path / "s.csv"
    f.write_bytes(b'id,Target,Snippet,CWE\r\n7,1,"a\nb\r\n""c""\r\n",CWE-79\r\n\r\n8,0,plain,\r\n9,1,"",x\r\n')
    for size in (5, 1000):
        block_bytes(size)
        got = sorted(tuple(r) for r in B.read_snippets_blocks(spark, str(f)).select("id", "Snippet", "Target", "CWE").collect())
        assert got == [("7", 'a\nb\r\n"c"\r\n', 1, "CWE-79"), ("8", "plain", 0, None), ("9", None, 1, "x")]


def test_many_tasks_read_one_file(spark, block_bytes, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("Snippet,Target,CWE\n" + "".join(f'"a{i}\n",{i % 2},\n' for i in range(400)))
    block_bytes(500)
    assert spark.read.text(str(f)).rdd.getNumPartitions() > 5
    plan = B.read_snippets_blocks(spark, str(f))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
    assert B.read_snippets_blocks(spark, str(f)).count() == 400


def test_header_alone_empty_folder_of_rows_and_missing_column(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("Snippet,Target,CWE\n")
    assert B.read_snippets_blocks(spark, str(f)).collect() == []
    f.write_text("Snippet,CWE\na,b\n")
    with pytest.raises(ValueError, match="Target"):
        B.read_snippets_blocks(spark, str(f))
