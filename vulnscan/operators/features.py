"""Token features.

The subword tokenizer of the original is replaced by a regex code
tokenizer (identifiers, numbers, literals, operators, newline marker). The
vocabulary holds every token of the data, however many there are: ids are
ranks of a range-partitioned sort, and ids are looked up by a plain equi-join of
the distinct tokens of groups of sequences (broadcast by Spark when the table is
small, else shuffled; a group has a token once, however frequent it is).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.constants import (
    BLOCK_SIZE,
    CLS_ID,
    CLS_TOKEN,
    CODE_TOKEN_RE,
    NEWLINE_MARKER,
    PAD_ID,
    PAD_TOKEN,
    SEP_ID,
    SEP_TOKEN,
    SPACE_MARKER,
    UNK_ID,
    UNK_TOKEN,
    N_RESERVED_IDS,
)
from ..functions.text import clean_multi_line
from ..session import BUCKETS_PER_PARTITION, scratch_path, stored_by


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def tokenize_code(text: Column | str) -> Column:
    """code tokens of a (cleaned) text; ``\\n`` becomes the newline marker."""
    toks = F.regexp_extract_all(_c(text), F.lit(CODE_TOKEN_RE), 0)
    return F.transform(toks, lambda t: F.when(t == "\n", F.lit(NEWLINE_MARKER)).otherwise(t))


def truncate_tokens(tokens: Column | str, block_size: int = BLOCK_SIZE) -> Column:
    """first ``block_size - 2`` tokens (room for the two markers)."""
    return F.slice(_c(tokens), 1, block_size - 2)


def with_markers(tokens: Column | str) -> Column:
    """``[cls] + tokens + [sep]``."""
    return F.concat(F.array(F.lit(CLS_TOKEN)), _c(tokens), F.array(F.lit(SEP_TOKEN)))


def pad_ids(ids: Column | str, block_size: int = BLOCK_SIZE) -> Column:
    """append pad ids up to ``block_size``."""
    ids = _c(ids)
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), F.lit(block_size) - F.size(ids))))


def attention_mask(ids: Column | str) -> Column:
    """F8: true where the id is not the pad id."""
    return F.transform(_c(ids), lambda x: x != PAD_ID)


def reserved_vocab(spark: SparkSession) -> DataFrame:
    rows = [(CLS_TOKEN, CLS_ID), (PAD_TOKEN, PAD_ID), (SEP_TOKEN, SEP_ID), (UNK_TOKEN, UNK_ID)]
    return spark.createDataFrame(rows, "token string, id int").withColumn("cnt", F.lit(0).cast("bigint"))


def build_vocab(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, id, cnt). Ids 0-3 are reserved; learnt tokens get
    ``4 + rank`` by (count desc, token asc). Counting uses partial
    aggregation, so a very frequent token collapses map-side."""
    counts = (
        # outer form + null filter: a plain explode would make Catalyst repeat
        # the tokenizing expression in an inferred ``size(...) > 0`` filter
        df.select(F.explode_outer(tokens_col).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    ranked = global_rank(counts, [F.desc("cnt"), F.asc("token")], "rank")
    learnt = ranked.select("token", (F.col("rank") + N_RESERVED_IDS).cast("int").alias("id"), "cnt")
    return reserved_vocab(df.sparkSession).unionByName(learnt)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank of every row in a total order.

    Rows are range-partitioned and sorted by all order columns (so equal leading
    values spread over partitions) and written once; a row's rank is its place in
    its partition plus the rows of the partitions before, of which one number a
    partition comes to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranked")
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    partition, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in stored.groupBy(partition.alias("p")).count().collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    first = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), partition.cast("int"))
    return stored.withColumn(name, first + place).drop("_at")


def running_sums(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Adds ``<column>_upto``: the sum of a whole-number column over all rows up to this
    one in a total order. As ``global_rank``: the sums within a range partition plus those
    of the partitions before, of which one row a partition comes to the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "running")
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_p", F.shiftright("_at", 33).cast("int"))
    parts = {r[0]: r[1:] for r in stored.groupBy("_p").agg(*[F.sum(c) for c in columns]).collect()}
    within = Window.partitionBy("_p").orderBy("_at")
    for k, c in enumerate(columns):
        before, total = [], 0
        for p in range(max(parts, default=0) + 1):
            before.append(total)
            total += parts[p][k] if p in parts else 0
        base = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_p"))
        stored = stored.withColumn(f"{c}_upto", base + F.sum(c).over(within))
    return stored.drop("_at", "_p")


#: Groups of sequences for each task of a lookup. A group is one Arrow table, and each of its
#: distinct items meets the vocabulary once.
GROUPS_PER_TASK = 4


def _look_up(
    src: DataFrame, table: DataFrame, key: str, seq: str, out: str, default, carry: tuple = (), keep: bool = False,
) -> DataFrame:
    """(key, *carry[, seq], out): for each item of the sequence ``seq`` its entry in ``table``
    (``_from``, ``_to``), else ``default``.

    Sequences are stored once, in groups by key. The distinct items of a group meet the
    table, which may be of any size, in a plain equi-join; what is found goes back to the
    group, and the items are replaced there. So a row of the join is a distinct item of a
    group, not a token, and the sequences are exchanged once. Null keys are one key; the
    sequences of a repeated key are merged by position."""
    tasks = BUCKETS_PER_PARTITION * int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS_PER_TASK * tasks)).alias("_group")
    rows = stored_by(src.select(group, key, *carry, seq), "_group")
    items = rows.select(F.col("_group").alias("_g"), F.explode(seq).alias("_from")).distinct()
    known = items.join(table, "_from").select("_g", "_from", "_to")
    to_type = ArrayType(table.schema["_to"].dataType)
    names = [key, *carry, *([seq] if keep else [])]
    schema = StructType([StructField(n, src.schema[n].dataType) for n in names] + [StructField(out, to_type)])

    def replaced(sequences: pa.Table, entries: pa.Table) -> pa.Table:
        lists = sequences.column(seq).combine_chunks()
        start, to = entries.column("_from"), entries.column("_to").combine_chunks()
        keys = sequences.column(key)
        once = pc.count_distinct(keys, mode="all").as_py() == len(keys)
        if not once or pc.count_distinct(start).as_py() < len(start):
            return merged(sequences, entries)
        values = lists.flatten()
        found = pc.fill_null(pc.take(to, pc.index_in(values, value_set=start)), pa.scalar(default, to.type))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        columns = {n: sequences.column(n) for n in names}
        if keep:  # a null sequence becomes an empty one
            columns[seq] = pa.ListArray.from_arrays(offsets, values)
        return pa.table({**columns, out: pa.ListArray.from_arrays(offsets, found)})

    def merged(sequences: pa.Table, entries: pa.Table) -> pa.Table:
        """The same where a key or an entry is repeated: an item has all its entries, and
        the items of a key are in the order of position, item and entry."""
        several: dict = {}
        for x, y in zip(entries.column("_from").to_pylist(), entries.column("_to").to_pylist()):
            several.setdefault(x, []).append(y)
        by_key: dict = {}
        for row in sequences.to_pylist():
            _, found = by_key.setdefault(row[key], (row, []))
            found += [(i, x, y) for i, x in enumerate(row[seq] or []) for y in several.get(x, [default])]

        def rank(x):
            return x is not None, x.encode() if isinstance(x, str) else x

        for _, found in by_key.values():
            found.sort(key=lambda t: (t[0], *([rank(t[1])] if keep else []), rank(t[2])))
        firsts = [row for row, _ in by_key.values()]
        columns = {n: pa.array([r[n] for r in firsts], sequences.schema.field(n).type) for n in names}
        if keep:
            columns[seq] = pa.array([[x for _, x, _ in found] for _, found in by_key.values()], sequences.schema.field(seq).type)
        to = pa.array([[y for _, _, y in found] for _, found in by_key.values()], pa.list_(entries.schema.field("_to").type))
        return pa.table({**columns, out: to})

    return rows.groupBy("_group").cogroup(known.groupBy("_g")).applyInArrow(replaced, schema)


def encode_ids(
    df: DataFrame, vocab: DataFrame, key: str, tokens_col: str = "tokens", carry: tuple = (),
) -> DataFrame:
    """(key, *carry, tokens, ids) with unknown tokens mapped to the unk id.

    The vocabulary may be of any size (``_look_up``). Empty and null token arrays give
    empty ones. ``carry`` columns are constant per key and ride along. The sequence
    of a key is one array, as it was in its input row.
    """
    src = df.select(key, *carry, F.col(tokens_col).alias("tokens"))
    table = vocab.select(F.col("token").alias("_from"), F.coalesce("id", F.lit(UNK_ID)).alias("_to"))
    return _look_up(src, table, key, "tokens", "ids", UNK_ID, carry, keep=True)


def decode_ids(df: DataFrame, vocab: DataFrame, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, tokens) by reverse lookup; unknown ids -> unk token."""
    src = df.select(key, F.col(ids_col).alias("ids"))
    table = vocab.select(F.col("id").alias("_from"), F.coalesce("token", F.lit(UNK_TOKEN)).alias("_to"))
    return _look_up(src, table, key, "ids", "tokens", UNK_TOKEN)


def build_examples(
    snippets: DataFrame, vocab: DataFrame, key: str = "row_id", block_size: int = BLOCK_SIZE, carry: tuple = (),
) -> DataFrame:
    """(key, *carry, label, cwe, input_tokens, input_ids) like the training
    examples: T5 clean, tokenize, truncate, markers, ids, pad."""
    src = snippets.select(
        key,
        *carry,
        F.col("Target").alias("label"),
        F.col("CWE").alias("cwe"),
        with_markers(truncate_tokens(tokenize_code(clean_multi_line("Snippet")), block_size)).alias(
            "input_tokens"
        ),
    )
    enc = encode_ids(src, vocab, key, "input_tokens", carry=(*carry, "label", "cwe"))
    return enc.select(
        key, *carry, "label", "cwe", F.col("tokens").alias("input_tokens"),
        pad_ids("ids", block_size).alias("input_ids"),
    )


def preview_tokens(tokens: Column | str) -> Column:
    """P2 display form: the space marker shown as ``_``."""
    return F.transform(_c(tokens), lambda x: F.replace(x, F.lit(SPACE_MARKER), F.lit("_")))
