"""Sources and sinks.

All paths may be any Hadoop file system path (HDFS, object store, local).
Files are read by Spark's own readers, so reading is split across tasks and
column pruning / partition pruning apply. The folders of ``write_code_files`` are listed
and read by tasks: Spark's file index keeps every file in the driver, and its planner
counts 4 MB for opening one, which makes a task of every few small files.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_utf8

SNIPPET_SCHEMA = "Snippet string, Target int, CWE string"


def csv_reader(spark: SparkSession):
    """A reader of snippet CSVs: header, line breaks in values, quotes doubled (RFC 4180)."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def columns_by_name(df: DataFrame, schema: str, path: str) -> DataFrame:
    """The columns of ``schema`` in their types, the others as strings after them."""
    named = [c.split() for c in schema.split(",")]
    missing = [n for n, _ in named if n not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    extra = [F.col(f"`{c}`") for c in df.columns if c not in {n for n, _ in named}]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in named], *extra)


def read_snippets(spark: SparkSession, path: str, schema: str = SNIPPET_SCHEMA) -> DataFrame:
    """Labelled snippet CSV, columns taken by name (in any order; others are kept
    as strings after them). Fails if a named column is missing or a value does not fit
    its type. Snippets hold newlines and quotes, so the reader needs ``multiLine`` and
    ``escape='"'`` (RFC 4180 doubling); such a file is read by one task. Large files:
    ``csv_blocks.read_snippets_blocks``."""
    return columns_by_name(csv_reader(spark).csv(path), schema, path)


def write_snippets_csv(df: DataFrame, path: str) -> None:
    """CSV in the same dialect ``read_snippets`` reads. The writer trims
    leading and trailing whitespace of every value by default, which would
    drop the final line break of a snippet: both trims are off."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_splits(df: DataFrame, path: str) -> None:
    """One table, ``partitionBy('split')`` (train / test / val folders)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S4 on a written table: the split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


#: Files in a folder that ``write_code_files`` makes.
FOLDER_FILES = 1000
#: Spark's name for the folder of a null or empty key, and the characters it escapes.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 0x20), *b"\"#%'*/:=?\\\x7f{[]^")}


def write_code_files(files: DataFrame, path: str, key: str = "doc_id", code: str = "code") -> None:
    """One text file per file key, whose path holds ``<key>=<value>`` (``file_key``).

    Repartitioning by the key first puts every key in exactly one task. Each row ends
    with one ``\\n``, as Spark's text sink (whose separator cannot be empty) has it.

    On a file system that all executors mount (``file:``) the tasks write
    ``folder=<f>/<key>=<value>.txt``, ``FOLDER_FILES`` in a folder: Spark's local sink starts
    a process (``chmod``) several times a file, moves the files one by one in the driver,
    and a folder a file makes the listing slow. Elsewhere the text sink writes a folder a key.
    """
    rows = files.select(key, code).repartition(key)
    root = local_path(path)
    if root is None:
        rows.write.mode("overwrite").partitionBy(key).text(path)
        return
    if os.path.isdir(root):
        shutil.rmtree(root)
    os.makedirs(root)
    named = rows.select(F.col(key).cast("string").alias("_key"), F.col(code).cast("binary").alias("_code")).sortWithinPartitions("_key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": [_write_files(batches, root, key)]}, pa.schema([("n", pa.int64())]))

    named.mapInArrow(write, "n long").agg(F.sum("n")).first()


def _write_files(batches: Iterator[pa.RecordBatch], root: str, key: str) -> int:
    """Writes rows sorted by key; a file gets its name when it is whole, so an attempt that
    is stopped or runs twice leaves no half file."""
    task = TaskContext.get()
    number, attempt = task.partitionId(), task.taskAttemptId()
    last, out, n, ends = None, None, 0, ("", "")
    for batch in batches:
        for value, code in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            value = value or None
            if out is None or value != last:
                if out is not None:
                    out.close()
                    os.replace(*ends)
                folder = os.path.join(root, f"folder=t{number}-{n // FOLDER_FILES}")
                if n % FOLDER_FILES == 0:
                    os.makedirs(folder, exist_ok=True)
                name = f"{key}={value.translate(_ESCAPED) if value else NO_KEY}.txt"
                ends = os.path.join(folder, f".{attempt}"), os.path.join(folder, name)
                out, last, n = open(ends[0], "wb"), value, n + 1
            out.write((code or b"") + b"\n")
    if out is not None:
        out.close()
        os.replace(*ends)
    return n


def local_path(path: str) -> str | None:
    """The path on this machine of a ``file:`` path; None for any other, also for one
    without a scheme, which is the default file system's."""
    rest = path.removeprefix("file:")
    rest = rest[2:] if rest.startswith("//") else rest
    return rest if path.startswith("file:") and rest.startswith("/") else None


def file_key(key: str = "doc_id", path: Column | str = "path") -> Column:
    """The key, as a string, in the path of a file of ``write_code_files`` (characters that
    its name escapes stay escaped); null for the file of null keys."""
    value = F.regexp_extract(path, rf"/{key}=([^/]*?)(?:\.txt|/[^/]*)$", 1)
    return F.when(~value.isin("", NO_KEY), value)


#: Tasks for each core that list and read folders, a folder a task at most.
READ_TASKS = 32
#: Bytes of files that a task puts into one batch of rows.
BATCH_BYTES = 4 << 20
_GLOB = re.compile(r"[*?{}\[\]\\]")
#: What a java.net.URI, as Spark shows the path of a text file, writes as ``%XX``.
_CODED = re.compile("[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def is_hidden(name: str) -> bool:
    """Whether Spark's readers leave out a file or folder of this name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def uri_path(path: str) -> str:
    """A local path as ``_metadata.file_path`` has it."""
    return "file:" + _CODED.sub(lambda m: quote(m[0], safe=""), path)


def written_folders(path: str) -> list[str] | None:
    """The folders under a path if it has nothing but those of ``write_code_files``."""
    root = local_root(path)
    if root is None:
        return None
    folders = []
    with os.scandir(root) as entries:
        for entry in entries:
            if is_hidden(entry.name):
                continue
            if not (re.fullmatch(r"folder=t[0-9]+-[0-9]+", entry.name) and entry.is_dir()):
                return None
            folders.append(f"{root}/{entry.name}")
    return sorted(folders) or None


def local_root(path: str) -> str | None:
    """The folder on this machine of a ``file:`` path without wildcards; None for others."""
    root = local_path(path)
    if root is None or _GLOB.search(root) or not os.path.isdir(root):
        return None
    return re.sub("/+", "/", root).rstrip("/")


def plain_path(path: str) -> str:
    """A local path as the binary reader has it."""
    return f"file:{path}"


def file_batches(paths: Iterable[str], shown: Callable[[str], str] = uri_path) -> Iterator[pa.RecordBatch]:
    """(path, content) of files, about ``BATCH_BYTES`` a batch, the paths as ``shown``.
    Empty files give no row, as in Spark's readers."""
    names: list[str] = []
    contents: list[bytes] = []
    size = 0
    for path in paths:
        with open(path, "rb") as f:
            content = f.read()
        if not content:
            continue
        names.append(shown(path))
        contents.append(content)
        size += len(content)
        if size >= BATCH_BYTES:
            yield _batch(names, contents)
            names, contents, size = [], [], 0
    if names:
        yield _batch(names, contents)


def _batch(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


def _files_in(folder: str, suffix: str) -> Iterator[str]:
    with os.scandir(folder) as entries:
        for entry in entries:
            if is_hidden(entry.name):
                continue
            if entry.is_dir():
                raise ValueError(f"{entry.path}: a folder among code files")
            if entry.name.endswith(suffix):
                yield entry.path


def _read_folders(spark: SparkSession, folders: list[str], suffix: str = "", shown: Callable[[str], str] = uri_path) -> DataFrame:
    """(path, content, length, folder) of the files in folders; tasks list and read them.
    The rows come from an RDD, so Spark takes them for a large table, not for one of as
    many bytes as there are folders."""
    sc = spark.sparkContext
    rows = sc.parallelize([(f,) for f in folders], min(len(folders), READ_TASKS * sc.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                value = folder.rpartition("/folder=")[2]
                for found in file_batches(_files_in(folder, suffix), shown):
                    values = pa.array([value] * found.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([*found.columns, values], ["path", "content", "folder"])

    files = spark.createDataFrame(rows, "dir string").mapInArrow(read, "path string, content binary, folder string")
    return files.select("path", "content", F.octet_length("content").cast("bigint").alias("length"), "folder")


def read_code_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: every file under ``path`` as one row (UTF-8; BOM and CR kept).

    Output: (path, code, <partition columns>). ``wholetext`` must be set as an
    option of the generic loader (H9).
    """
    folders = written_folders(path)
    if folders is not None:
        return _read_folders(spark, folders).select("path", F.col("content").cast("string").alias("code"), "folder")
    df = spark.read.format("text").option("wholetext", True).load(path)
    extra = [c for c in df.columns if c != "value"]
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"), *extra)


def read_code_bytes(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Raw bytes of every file: (path, content, length, <partition columns>)."""
    folders = written_folders(path) if glob == "*.txt" else None
    if folders is not None:
        return _read_folders(spark, folders, ".txt", plain_path)
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    extra = [c for c in df.columns if c not in ("path", "modificationTime", "length", "content")]
    return df.select("path", "content", "length", *extra)


def decode_files(raw: DataFrame) -> DataFrame:
    """Strict UTF-8 decode; ``valid`` false marks files to quarantine."""
    return raw.withColumn("valid", F.is_valid_utf8("content")).withColumn("code", decode_utf8("content"))


def file_manifest(raw: DataFrame) -> DataFrame:
    """md5 and byte size of every file."""
    extra = [c for c in raw.columns if c not in ("path", "content", "length")]
    return raw.select(
        "path", *extra, F.md5("content").alias("md5"), F.col("length").cast("bigint").alias("size")
    )


def manifest_mismatches(actual: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """S5 check: expected entries that are missing or differ (anti-join)."""
    return expected.join(actual.select(key, "md5", "size"), [key, "md5", "size"], "left_anti")
