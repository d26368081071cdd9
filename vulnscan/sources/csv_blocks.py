"""S1 for large files: one CSV file read by many tasks although records hold line breaks.

Spark's ``multiLine`` reader takes a file whole, since a task that begins in the middle of
a file cannot tell whether it stands inside quotes. Here the text reader cuts files into
blocks (``spark.sql.files.maxPartitionBytes``) at line ends, and

1. each block is reduced to the map from "entered outside / inside quotes" to its state at
   the end and its number of records (the parity of its quotes, and the counts of its lines
   before which the number of quotes is even and odd);
2. a running sum over the blocks of a file (one small row each) tells how each is entered,
   and which earlier block holds the start of a record that runs into it;
3. lines are put together to records in their block; only pieces of records that cross a
   block's end meet by a further exchange.

The lines are exchanged once, by (file, block). A record, like any value, must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import SNIPPET_SCHEMA, columns_by_name, csv_reader

BLOCK = ("_file", "_block")
PARSE = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _in_order(place: str, text: str) -> Column:
    """The texts of a group by their place, a line break between two."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), "\n")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, record): every record of the CSV files under ``path`` as text,
    with the block it starts in and its number there from 1. Quotes are as RFC 4180 has
    them: a value with a quote is quoted, quotes in it are doubled. A line break that ends
    a record is LF or CRLF and no part of it; within quotes both are kept. Empty lines
    between records are left out, as Spark's reader does; they count in ``number``."""
    raw = spark.read.format("text").option("lineSep", "\n").load(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_line"),
    )
    within = Window.partitionBy(*BLOCK).orderBy("_at")
    quotes = F.length("_line") - F.length(F.replace("_line", F.lit('"'), F.lit("")))
    lines = lines.withColumn("_quotes", quotes)
    earlier = F.sum("_quotes").over(within.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_odd", F.coalesce(earlier, F.lit(0)) % 2)

    in_file = Window.partitionBy("_file").orderBy("_block")
    so_far = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*BLOCK).agg(
        F.sum("_quotes").alias("_quotes"), F.count_if(F.col("_odd") == 0).alias("_even_lines"), F.count_if(F.col("_odd") == 1).alias("_odd_lines"))
    blocks = blocks.withColumn("_inside", F.coalesce(F.sum("_quotes").over(so_far), F.lit(0)) % 2)
    blocks = blocks.withColumn("_starts", F.when(F.col("_inside") == 0, F.col("_even_lines")).otherwise(F.col("_odd_lines")))
    last_start = F.when(F.col("_starts") > 0, F.struct("_block", "_starts"))
    blocks = blocks.select(
        *BLOCK, "_inside", "_starts", F.last(last_start, ignorenulls=True).over(so_far).alias("_owner"),
        (F.lead("_inside", 1, 0).over(in_file) == 1).alias("_runs_on"))

    starts = F.when((F.col("_odd") + F.col("_inside")) % 2 == 0, 1).otherwise(0)
    numbered = lines.join(blocks, list(BLOCK)).withColumn("_number", F.sum(starts).over(within))
    pieces = numbered.groupBy(*BLOCK, "_number").agg(
        _in_order("_at", "_line").alias("_text"), *[F.first(c).alias(c) for c in ("_starts", "_owner", "_runs_on")])
    # number 0: the rest of a record of an earlier block
    rest = F.col("_number") == 0
    crosses = rest | (F.col("_runs_on") & (F.col("_number") == F.col("_starts")))
    home = F.when(rest, F.col("_owner._block")).otherwise(F.col("_block")).alias("block")
    number = F.when(rest, F.col("_owner._starts")).otherwise(F.col("_number")).alias("number")
    pieces = pieces.select(F.col("_file").alias("file"), home, number, "_block", "_text", crosses.alias("_crosses"))
    whole = pieces.filter(~F.col("_crosses")).select("file", "block", "number", "_text")
    joined = pieces.filter("_crosses").groupBy("file", "block", "number").agg(_in_order("_block", "_text").alias("_text"))
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("_text", r"\r\z", ""))
    return records.filter(F.col("record") != "").drop("_text")


def read_snippets_blocks(spark: SparkSession, path: str, schema: str = SNIPPET_SCHEMA) -> DataFrame:
    """As ``read_snippets``, each file by many tasks. Every file begins with its header
    line; all have the columns of the first one that Spark names. Folder names of the form
    ``key=value`` add no columns. In files whose lines end with CRLF, ``read_snippets``
    turns a CRLF within quotes into LF; here values stay as they are."""
    names = csv_reader(spark).csv(path).columns
    places = ", ".join(f"c{i} string" for i in range(len(names)))
    records = csv_records(spark, path).filter((F.col("block") > 0) | (F.col("number") > 1))
    row = records.select(F.from_csv("record", places, PARSE).alias("_row"))
    df = row.select(*[F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)])
    return columns_by_name(df, schema, path)
