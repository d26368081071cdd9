"""Incremental scan of new code files with Structured Streaming.

New files in a folder are picked up by a source (one row per file): ``new_files``
where source and checkpoint are ``file:`` folders, else Spark's file source
(``wholetext``). Every micro-batch runs the batch scan (E1) inside
``foreachBatch`` (its row-number windows are not allowed in a streaming
plan) and overwrites its own ``batch_id=<n>`` folder of the sink, so a
re-run of a batch after a failure replaces, never duplicates, its output.
Progress is kept in the checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.jobs import scan_files
from ..sources.io import local_path, local_root, uri_path
from .new_files import LIST, NewFiles

KEY = "path"


def _with_key(df: DataFrame) -> DataFrame:
    """The key of a file is its path, whatever its folder is called."""
    return df.select(F.col("_metadata.file_path").alias(KEY), F.col("value").alias("code"))


def _new_files(spark: SparkSession, src_dir: str, checkpoint_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    """The stream of (path, code). Spark's source, too, limits the files of a trigger, and
    goes on with a checkpoint that it began."""
    root, checkpoint = local_root(src_dir), local_path(checkpoint_dir)
    listed = os.path.join(checkpoint, LIST) if checkpoint else None
    if root and listed and not max_files_per_trigger and not os.path.isdir(f"{checkpoint}/sources"):
        spark.dataSource.register(NewFiles)
        files = spark.readStream.format(NewFiles.name()).option("root", root).option("list", listed).load()
        return files.select(F.col("path").alias(KEY), F.col("content").cast("string").alias("code"))
    if listed and os.path.isdir(listed):
        raise ValueError(f"{checkpoint_dir}: begun without a limit of files from a folder that is not there now or is limited")
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _with_key(reader.load(src_dir))


def start_scan_stream(
    spark: SparkSession,
    src_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the stream; returns the ``StreamingQuery``."""
    files = _new_files(spark, src_dir, checkpoint_dir, max_files_per_trigger)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # one pass, nothing written besides the sink
        out = scan_files(batch, key=KEY)
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    writer = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def run_scan_stream(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint_dir: str, **kw) -> DataFrame:
    """Process everything available now, then read the sink."""
    q = start_scan_stream(spark, src_dir, sink_dir, checkpoint_dir, available_now=True, **kw)
    q.awaitTermination()
    return spark.read.parquet(sink_dir)
