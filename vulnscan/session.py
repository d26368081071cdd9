"""Session and scratch-space helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(app: str = "vulnscan", **settings) -> SparkSession:
    """The running session, unchanged, or else a new one.

    Master, memory and shuffle partitions belong to spark-submit or the
    cluster's configuration; tests and the bench pass theirs in ``settings``
    (dots as double underscores, e.g. ``spark__master="local[8]"``).
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def local_settings(cpus: int | str = 8, shuffle_partitions: int = 8) -> dict:
    """Settings for single-machine runs (tests, bench, scripts)."""
    return {
        "spark__master": f"local[{cpus}]",
        "spark__sql__shuffle__partitions": shuffle_partitions,
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__sql__session__timeZone": "UTC",
        "spark__driver__memory": "16g",
        # without a Python stack trace for every column expression, plans are built faster
        "spark__sql__dataFrameQueryContext__enabled": "false",
    }


def share_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it (clusters install
    it or pass it with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; raises if there is none,
    since a machine-local folder would be invisible to other executors."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def local_checkpoint_dir(spark: SparkSession) -> None:
    """For entry points run on one machine (tests, bench): names a checkpoint folder
    where the session has none. Does nothing on a cluster, where the missing setting
    must surface as an error."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vulnscan-checkpoint-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder), so a
    lost executor does not force recomputation of the whole lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Parts for each shuffle partition of rows that grow in the tasks which read them.
GROWING_PARTS = 4


#: Bytes of such rows in a part: beyond the least number, the parts grow with the input.
PART_BYTES = 2 << 20
MAX_PARTS = 100_000


def parts_for(df: DataFrame, size: Column, each: int, least: int) -> int:
    """Number of parts in which the sum of ``size`` is about ``each``: one pass over the
    columns that ``size`` reads."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return min(max(least, -(-total // each)), max(least, MAX_PARTS))


def by_key(df: DataFrame, *keys: str, text: Column | str) -> DataFrame:
    """The rows hash-partitioned by the keys, for steps that make many rows of each ``text``.

    The number of parts follows from the bytes of the texts: AQE sizes the tasks of an
    exchange by the bytes that are exchanged and would join parts up to its advisory size,
    but a task here sorts the rows that are made of them, many times as large as the
    exchanged texts."""
    least = GROWING_PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts_for(df, F.octet_length(text), PART_BYTES, least), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the scratch folder, for steps that read them more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Buckets of a pinned table for each shuffle partition: parts fall into buckets by hash,
#: so a few more buckets than tasks keep them apart. Spark allows 100,000.
BUCKETS_PER_PARTITION = 4
MAX_BUCKETS = 100_000


def pin_rows(df: DataFrame) -> DataFrame:
    """The rows, written once to the scratch folder, with ``_part`` (the task that wrote the
    row) and ``_row`` (a long, unique and fixed from then on; ``_part`` is its upper part).

    The table is bucketed by ``_part``, which each task's rows share, so writing moves no
    row, and a join on ``_part`` leaves the rows where they are: only the other side is
    exchanged. Spark learns the layout through a table name, which is dropped again; the
    files stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    table = f"pinned_{uuid.uuid4().hex}"
    buckets = min(MAX_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed.write.format("parquet").bucketBy(buckets, "_part").option("path", path).saveAsTable(table)
    pinned = spark.table(table).select(*placed.columns)
    spark.sql(f"DROP TABLE {table}")
    return pinned


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """The rows, written once to the scratch folder in buckets of a column, of which each is
    a task's: grouping or joining by the column leaves these rows where they are."""
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    table = f"stored_{uuid.uuid4().hex}"
    buckets = min(MAX_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
    rows = spark.table(table).select(*df.columns)
    spark.sql(f"DROP TABLE {table}")
    return rows


def place_of(row: Column | str) -> tuple[Column, Column]:
    """(``_part``, number of the row in its part from 0) of a ``_row`` column."""
    row = F.col(row) if isinstance(row, str) else row
    return F.shiftright(row, 33).cast("int"), row.bitwiseAND(F.lit((1 << 33) - 1))
