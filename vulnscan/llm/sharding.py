"""Operator 9 [native]: shards by sampled splitters.

Law ``bytes``: shard sizes are near equal. Records are keyed by (text hash,
id, row number); a size-weighted sample of keys gives quantile boundaries (a small
record counts as one of mean size, so that many tiny ones, equal texts too, do not share
a range), the boundaries cut all records into fine ranges, and exact byte totals of the ranges
place them in shards. A range that is overfull, i.e. crosses a shard boundary
(always so for one that holds more than a shard), is subdivided by the running
bytes of its own records. So shards differ by at most the largest record.

Equal texts share the leading key, hence lie next to each other: in one shard
unless a boundary falls into the group. A group that is larger than a shard is
subdivided by id and row number like any range.

What goes through the driver: the boundaries, at most ``MAX_RANGES`` keys, as the value
of a scalar subquery. The sample, about ``SAMPLES_PER_RANGE`` times as many keys, is
sorted in one task; texts are never shuffled, only (id, size, crc, hash) rows.

Defined cases: null text has size 1 (no bytes plus 1) and the crc of the empty
text; null ids are kept; repeated rows are kept row by row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16
#: Records a range holds on average, and keys sampled for each range.
RANGE_ROWS = 200
SAMPLES_PER_RANGE = 4
#: Most ranges: bounds the boundaries that the driver and each task hold (1.5 MB). Beyond
#: MAX_RANGES * RANGE_ROWS records the ranges get longer: 150,000 records at 10 billion.
MAX_RANGES = 65_536
_SPREAD = 1 << 40


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One small row for each record, stored once: all later steps read these."""
    body = F.coalesce(F.col(text), F.lit(""))
    return C.stored(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        F.monotonically_increasing_id().alias("row")), "sharding-keys")


def _key() -> Column:
    return F.struct("h", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "row")


def splitters(rows: DataFrame, n_rows: int, n_bytes: int) -> DataFrame:
    """One row (heads, stretches): the sorted boundaries in stretches of near the square
    root of their number, and the first of each stretch. Boundaries are quantiles of a key
    sample in which a record's chance to be drawn is its share of the bytes or of the
    records, whichever is more: a range is bounded in both."""
    ranges = max(1, min(MAX_RANGES, n_rows // RANGE_ROWS))
    drawn = F.lit(float(ranges * SAMPLES_PER_RANGE))
    share = F.greatest(F.col("size") / F.lit(float(max(1, n_bytes))), F.lit(1 / max(1, n_rows)))
    draw = F.pmod(F.xxhash64(F.lit(9), "h", "doc_id", "row"), F.lit(_SPREAD)) / F.lit(float(_SPREAD))
    sample = rows.filter(draw < share * drawn).agg(F.array_sort(F.collect_list(_key())).alias("keys"))
    quantiles = F.filter("keys", lambda k, i: i % SAMPLES_PER_RANGE == SAMPLES_PER_RANGE - 1)
    stretch = max(1, math.isqrt(ranges))
    starts = F.filter(F.sequence(F.lit(0), F.size("bounds")), lambda i: (i % stretch == 0) & (i < F.size("bounds")))
    cut = sample.select(quantiles.alias("bounds")).select(
        F.transform(starts, lambda i: F.slice("bounds", i + 1, stretch)).alias("stretches"))
    return C.stored(cut.select(F.transform("stretches", lambda s: s[0]).alias("heads"), "stretches"), "sharding-splitters")


def ranged(rows: DataFrame, n_rows: int, n_bytes: int) -> DataFrame:
    """Adds ``range``, the number of boundaries at or below the row's key, found in two
    steps: among the heads, then inside that stretch."""
    bounds = splitters(rows, n_rows, n_bytes).select(F.struct("heads", "stretches"))
    found = F.col("_bounds")
    k = _key()
    block = F.size(F.filter(found["heads"], lambda b: b <= k)) - 1
    inside = F.size(F.filter(F.get(found["stretches"], F.col("_block")), lambda b: b <= k))
    length = F.size(F.get(found["stretches"], F.lit(0)))  # of each but the last
    number = F.when(F.col("_block") < 0, 0).otherwise(F.col("_block") * length + inside)
    found_block = rows.select("*", bounds.scalar().alias("_bounds")).withColumn("_block", block)
    return found_block.withColumn("range", number.cast("int")).drop("_bounds", "_block")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard)."""
    rows = keyed(docs, doc_id, text)
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = ranged(rows, n_rows, n_bytes)
    # one row for each range: exact totals, and what lies before it
    totals = placed.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    inside = W.partitionBy("range").orderBy("h", "doc_id", "row")
    ranked = placed.select("*", (F.row_number().over(inside) - 1).alias("n"),
                           (F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("b"))
    placed = ranked.join(F.broadcast(totals), "range").select(  # at most MAX_RANGES + 1 rows
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("n")).alias("rank"),
        # the shard in which the middle of the record's bytes falls
        F.floor((F.col("bytes_before") + F.col("b") + F.col("size") / 2) * shards / F.lit(max(1, n_bytes))).cast("int").alias("shard"))
    placed = C.stored(placed.withColumn("shard", F.least("shard", F.lit(shards - 1))), "sharding-places")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # `shards` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(C.documents(spark, sf_dir)).withColumn("grown_shard", F.lit(None).cast("int"))
