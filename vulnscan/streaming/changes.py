"""S5 + S7: only changed files are scanned again, deleted ones are reported.

Snapshots of a code base (path, code, seen_at) are appended to a folder. The stream keeps
one checksum a path in a table; the paths' newest versions in a batch are joined with it,
and unchanged versions end there: texts of changed paths alone are looked up. A path is
deleted when the watermark, which later snapshots push on, has passed its last sight. Each
batch stores its changes and the scan (E1) of the added and changed files in folders of its
own, so a retried batch replaces its output. Progress lies in the stream's checkpoint, and
so does the table, as the last two batches left it: a retried batch starts from the one
before it.

``grace`` is how much later than a path's last sight a snapshot must be before the path
counts as deleted. Where a snapshot may arrive over several batches, take more than the time
between two snapshots. Snapshots not later than the watermark are late and left out. A
path that is gone and back between two batches shows as its net change.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.jobs import scan_files

SNAPSHOT = "path string, code string, seen_at timestamp"
CHANGE = "path string, change string, md5 string, at_ms long, code string"
#: ``change`` and ``watermark_ms`` as of the batch that left the row.
STATE = "path string, md5 string, at_ms long, change string, watermark_ms long"


def append_snapshot(files: DataFrame, folder: str, seen_at: datetime) -> None:
    """Adds a snapshot of (path, code) rows, seen at one time."""
    at = F.lit(seen_at).cast("timestamp").alias("seen_at")
    files.select("path", "code", at).write.mode("append").parquet(folder)


def _millis(spark: SparkSession, interval: str) -> int:
    day = "timestamp_ntz'2024-01-01'"
    (ms,) = spark.sql(f"SELECT timestampdiff(MILLISECOND, {day}, {day} + cast(:grace AS interval))", {"grace": interval}).first()
    if ms is None or ms < 0:
        raise ValueError(f"grace: not a length of time: {interval!r}")
    return ms


def _gone() -> Column:
    return F.col("at_ms") + 1 < F.col("watermark_ms")


def _versions(snapshots: DataFrame) -> DataFrame:
    """A null code counts as a version of its own; rows without path or time are left out."""
    return snapshots.filter("path is not null and seen_at is not null").select(
        "path", "code", "seen_at", F.coalesce(F.md5("code"), F.lit("")).alias("md5"), F.unix_millis("seen_at").alias("at_ms"))


def track_versions(snapshots: DataFrame, state: DataFrame, grace: str = "0 seconds") -> DataFrame:
    """STATE after a batch of snapshots, from the one before it."""
    late = state.agg(F.max("watermark_ms")).first()[0] or 0
    rows = _versions(snapshots).filter(F.col("seen_at") > F.timestamp_millis(F.lit(late)))
    newest_at = rows.agg(F.max("at_ms")).first()[0]
    watermark = late if newest_at is None else max(late, newest_at - _millis(state.sparkSession, grace))
    newest = rows.groupBy("path").agg(F.max(F.struct("at_ms", "md5")).alias("_new"))
    known = state.filter(~_gone()).select("path", F.struct("at_ms", "md5").alias("_known"))
    change = F.when(F.col("_known").isNull(), "added").when(F.col("_new.md5") != F.col("_known.md5"), "changed")
    return newest.join(known, "path", "full_outer").select(
        "path", F.coalesce("_new.md5", "_known.md5").alias("md5"), F.greatest("_new.at_ms", "_known.at_ms").alias("at_ms"),
        change.alias("change"), F.lit(watermark).cast("long").alias("watermark_ms"))


def file_changes(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change, md5, at_ms, code) of a batch of snapshots and the STATE after it:
    ``added``, ``changed`` or ``deleted`` (then the last checksum and sight, without code).
    A path that comes and goes in one batch has two rows."""
    new = state.filter("change is not null").select("path", "md5", "change", "at_ms")
    found = _versions(snapshots).select("path", "md5", "code").join(new, ["path", "md5"])
    gone = state.filter(_gone()).select("path", F.lit("deleted").alias("change"), "md5", "at_ms", F.lit(None).cast("string").alias("code"))
    # a version may have several rows
    return found.dropDuplicates(["path", "md5"]).select(*gone.columns).unionAll(gone)


def run_change_scan(spark: SparkSession, folder: str, sink: str, checkpoint: str, grace: str = "0 seconds") -> DataFrame:
    """Takes in all snapshots that have come, then returns the log of changes:
    (path, change, md5, at_ms, code, batch_id)."""

    def state_after(batch_id: int) -> str:
        return f"{checkpoint}/known/{batch_id % 2}"

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(STATE).parquet(state_after(batch_id - 1)) if batch_id > 0 else spark.createDataFrame([], STATE)
        track_versions(batch, known, grace).write.mode("overwrite").parquet(state_after(batch_id))
        state = spark.read.schema(STATE).parquet(state_after(batch_id))
        changes = f"{sink}/changes/batch_id={batch_id}"
        file_changes(batch, state).write.mode("overwrite").parquet(changes)
        to_scan = spark.read.schema(CHANGE).parquet(changes).filter("change <> 'deleted' and code is not null")
        if batch_id > 0 and to_scan.isEmpty():  # the first batch leaves a folder with the columns
            return
        scan_files(to_scan.select("path", "code"), key="path").write.mode("overwrite").parquet(f"{sink}/scans/batch_id={batch_id}")

    snapshots = spark.readStream.schema(SNAPSHOT).parquet(folder)
    writer = snapshots.writeStream.foreachBatch(run_batch)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return change_log(spark, sink)


def change_log(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(f"{CHANGE}, batch_id long").parquet(f"{sink}/changes")


def live_scans(spark: SparkSession, sink: str) -> DataFrame:
    """The scan rows of every file that is there, in its newest version. In a batch, a
    deletion is a path's last change (and the last by name)."""
    last = change_log(spark, sink).groupBy("path").agg(F.max(F.struct("batch_id", "change")).alias("_last"))
    last = last.filter("_last.change <> 'deleted'").select("path", F.col("_last.batch_id").alias("batch_id"))
    return spark.read.parquet(f"{sink}/scans").join(last, ["path", "batch_id"], "left_semi").drop("batch_id")
