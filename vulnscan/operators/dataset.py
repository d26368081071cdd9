"""Dedup and reproducible splits.

The exact 70/15/15 split needs a global rank of every row in a seeded hash
order. A global ``row_number()`` without a partition would pull every row
into one task; instead the hash prefix (``prefix_len`` hex digits, 65,536
buckets by default) is counted, the counts are turned into offsets on that
small table, and the offsets are broadcast back (the table has at most
16**prefix_len rows, a bound fixed by construction). The rank is then
``offset + row_number()`` inside a bucket, so the sort is spread over as many
tasks as there are buckets, and uniform hashes keep the buckets even.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import HOLD_FRACTION_VAL, SEED, TRAIN_FRACTION_HOLD
from ..session import pin_rows, place_of, scratch_path

FIELD_SEP = "\x1f"
SNIPPET_COLS = ("Snippet", "Target", "CWE")


def row_hash(cols, seed: int = SEED) -> Column:
    """md5 over a seed and all columns. Each value stands with its length before it
    and NULL as ``-``, so different rows never give the same input."""
    def part(c):
        text = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(F.lit(f"{seed};"), *[part(c) for c in cols]))


def project_snippets(df: DataFrame) -> DataFrame:
    """The three named columns."""
    return df.select(*SNIPPET_COLS)


def cwe_as_string(df: DataFrame) -> DataFrame:
    """Missing CWE shown as ``'nan'`` (parity view; NULL is kept elsewhere)."""
    return df.select(
        "Snippet", "Target", F.coalesce(F.col("CWE"), F.lit("nan")).alias("CWE")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every distinct row that occurs more than once, with the number of
    repeats beyond the first (NULLs compare equal). Partial aggregation
    collapses a hot duplicate group on the map side."""
    cols = df.columns
    return (
        df.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(*cols, (F.col("n") - 1).alias("n_extra"))
    )


def row_group(cols) -> Column:
    """A 64-bit hash that equal rows share (NULLs, NaNs and both zeros compare equal)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


def row_digest(df: DataFrame) -> Column:
    """SHA-256 (hex) over all columns, each with its length before it and NULL as ``-``, so
    rows of one digest are equal. Equal rows may differ in it (0.0 and -0.0): that only
    sends them to the full comparison."""
    def part(field):
        c = F.col(f"`{field.name}`")
        nested = field.dataType.typeName() in ("array", "struct")
        text = F.to_json(c) if nested else c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in df.schema.fields]).cast("binary"), 256)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one row of every group of equal rows. Whole rows are exchanged: for tables
    of short rows; for long texts see ``drop_duplicates_in_place``."""
    return df.dropDuplicates()


def drop_duplicates_in_place(df: DataFrame, group=row_group) -> DataFrame:
    """X2 without moving rows: keep one row of every group of equal rows (NULLs compare equal).

    Rows are written once and stay in place. Only (hash, digest, place) is exchanged: a
    hash group whose rows agree in the digest keeps its first place. Rows of groups with
    one hash and several digests (a collision of hashes, or equal values spelt
    differently) are unsure: they alone are moved and compared whole. Which rows of a part
    are kept or unsure goes back to the part as two bits a row. ``group`` maps column
    names to the hash.

    An empty table stays empty; columns of map type cannot be compared, as in Spark.
    """
    spark, cols = df.sparkSession, df.columns
    digest = row_digest(df)
    digests = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(name) for at, name in ((1, "_d1"), (17, "_d2"))]
    rows = pin_rows(df.select("*", group(cols).alias("_h"), *digests))
    groups = rows.groupBy("_h").agg(
        F.min("_row").alias("_row"),
        ((F.min("_d1") != F.max("_d1")) | (F.min("_d2") != F.max("_d2"))).alias("_mixed"),
    )
    first = groups.filter(~F.col("_mixed")).select("_row")
    unsure = rows.select("_row", "_h").join(groups.filter("_mixed").select("_h"), "_h", "left_semi").select("_row")
    path = scratch_path(spark, "kept-rows")
    row_bits(rows, {"_kept": first, "_unsure": unsure}).write.parquet(path)
    bits = spark.read.parquet(path)
    marked = rows.join(bits, "_part").withColumn("_n", place_of("_row")[1])
    kept = marked.filter(has_bit("_kept", "_n")).select(*cols)
    if bits.filter(F.exists("_unsure", lambda w: w != 0)).isEmpty():
        return kept
    return kept.unionByName(marked.filter(has_bit("_unsure", "_n")).select(*cols).dropDuplicates())


def row_bits(rows: DataFrame, marks: dict[str, DataFrame]) -> DataFrame:
    """For each part of pinned rows, one row (_part, and for each mark an array of longs):
    bit ``n % 64`` of entry ``n // 64`` tells whether row ``n`` of the part is marked."""
    def words(marked: DataFrame, name: str | None) -> DataFrame:
        part, number = place_of("_row")
        bit = F.expr("shiftleft(1L, CAST(_n % 64 AS INT))")
        placed = marked.select(part.alias("_part"), number.alias("_n"))
        return placed.select("_part", F.shiftright("_n", 6).alias("_word"), *[
            (bit if m == name else F.lit(0).cast("long")).alias(m) for m in marks])

    table = words(rows, None)  # every word occurs, so entries are found by their place
    for name, marked in marks.items():
        table = table.unionAll(words(marked, name))
    table = table.groupBy("_part", "_word").agg(*[F.bit_or(m).alias(m) for m in marks])
    in_order = F.array_sort(F.collect_list(F.struct("_word", *marks)))
    return table.groupBy("_part").agg(in_order.alias("_all")).select(
        "_part", *[F.col("_all").getField(m).alias(m) for m in marks])


def has_bit(words: str, n: str) -> Column:
    return F.expr(f"bit_get(get({words}, CAST(shiftright({n}, 6) AS INT)), CAST({n} % 64 AS INT)) = 1")


def exact_rank(df: DataFrame, hash_col: str, prefix_len: int = 4) -> DataFrame:
    """0-based rank of every row in ``hash_col`` order, plus the row count
    ``n``, without a single-partition window over the rows."""
    d = df.withColumn("_bucket", F.substring(F.col(hash_col), 1, prefix_len))
    counts = d.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # At most 16**prefix_len rows: a global window here is bounded.
    w = Window.orderBy("_bucket")
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_base"
        ),
        F.sum("_cnt").over(Window.partitionBy()).alias("n"),
    )
    wb = Window.partitionBy("_bucket").orderBy(hash_col)
    ranked = d.join(F.broadcast(offsets), "_bucket").withColumn(
        "rnk", (F.col("_base") + F.row_number().over(wb) - 1).cast("bigint")
    )
    return ranked.drop("_bucket", "_base")


def split_sizes(n: Column) -> tuple[Column, Column, Column]:
    """(n_train, n_test, n_val): ``n_hold = ceil(0.3 n)``, ``n_val =
    ceil(0.5 n_hold)``, ``n_test = n_hold - n_val`` (double arithmetic)."""
    n_hold = F.ceil(F.lit(TRAIN_FRACTION_HOLD) * n.cast("double"))
    n_val = F.ceil(F.lit(HOLD_FRACTION_VAL) * n_hold.cast("double"))
    return n - n_hold, n_hold - n_val, n_val


def cut_hashes(df: DataFrame, hash_col: str, prefix_len: int = 4) -> DataFrame:
    """One row (test_from, val_from): the hashes at which the test and the validation part
    begin in hash order; null for an empty table. A radix selection: hashes are counted
    by prefix, and only those of the two prefixes that hold a cut are ranked."""
    d = df.select(F.col(hash_col).alias("_h"), F.substring(F.col(hash_col), 1, prefix_len).alias("_bucket"))
    counts = d.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # at most 16**prefix_len rows: a global window here is bounded
    whole = Window.orderBy("_bucket")
    before = F.coalesce(F.sum("_cnt").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("_bucket", "_cnt", before.alias("_base"), F.sum("_cnt").over(Window.partitionBy()).alias("n"))
    n_train, n_test, _ = split_sizes(F.col("n"))
    cuts = places.select("_bucket", "_base", "_cnt", F.explode(F.array(
        F.struct(F.lit("test_from").alias("cut"), n_train.alias("at")), F.struct(F.lit("val_from").alias("cut"), (n_train + n_test).alias("at")))).alias("_x"))
    cuts = cuts.select("_bucket", "_base", "_cnt", "_x.*").filter((F.col("at") >= F.col("_base")) & (F.col("at") < F.col("_base") + F.col("_cnt")))
    in_bucket = d.join(F.broadcast(cuts), "_bucket")  # two rows
    order = Window.partitionBy("cut").orderBy("_h")
    ranked = in_bucket.withColumn("_rnk", F.col("_base") + F.row_number().over(order) - 1).filter(F.col("_rnk") == F.col("at"))
    return ranked.agg(*[F.max(F.when(F.col("cut") == c, F.col("_h"))).alias(c) for c in ("test_from", "val_from")])


def split_by_cut(df: DataFrame, seed: int = SEED, prefix_len: int = 4) -> DataFrame:
    """X3 without ranks: the same ``row_id`` and ``split`` as ``split_exact``. A row's split is
    a comparison of its hash with two cut hashes, which come in as scalars; rows stay where
    they are, and only hashes and counts are exchanged. Input rows must be unique."""
    d = df.withColumn("row_id", row_hash(df.columns, seed))
    cuts = cut_hashes(d, "row_id", prefix_len).select(F.struct("test_from", "val_from")).scalar()
    split = F.when(F.col("row_id") < cuts["test_from"], "train").when(F.col("row_id") < cuts["val_from"], "test").otherwise("val")
    return d.withColumn("split", split)


def split_exact(df: DataFrame, seed: int = SEED, prefix_len: int = 4) -> DataFrame:
    """Exact 70/15/15 sizes in a seeded shuffled order (not stratified).

    Input rows must be unique (run X2 first). Adds ``row_id`` (seeded md5 of
    all columns), ``rnk`` (position in the shuffled order) and ``split``.
    """
    cols = df.columns
    d = df.withColumn("row_id", row_hash(cols, seed))
    r = exact_rank(d, "row_id", prefix_len)
    n_train, n_test, _ = split_sizes(F.col("n"))
    split = (
        F.when(F.col("rnk") < n_train, "train")
        .when(F.col("rnk") < n_train + n_test, "test")
        .otherwise("val")
    )
    return r.withColumn("split", split).drop("n")


def split_hash(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Approximate 70/15/15 from the row hash alone; stable under appends
    and usable in a stream (no global state)."""
    cols = df.columns
    h = row_hash(cols, seed)
    v = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 10000
    split = F.when(v < 7000, "train").when(v < 8500, "test").otherwise("val")
    return df.withColumn("row_id", h).withColumn("split", split)


def shuffle_order(df: DataFrame, id_col: str = "row_id", seed: int = SEED, prefix_len: int = 4) -> DataFrame:
    """A seeded random permutation: position of every row."""
    d = df.withColumn("_perm_hash", F.md5(F.concat(F.lit(f"{seed}{FIELD_SEP}"), F.col(id_col))))
    r = exact_rank(d, "_perm_hash", prefix_len)
    return r.withColumnRenamed("rnk", "perm_idx").drop("_perm_hash", "n")


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Pick one split; on a table written with ``partitionBy('split')``
    this is a partition-pruned scan."""
    if split not in ("train", "test", "val"):
        raise ValueError(f"unknown split {split!r}")
    return df.filter(F.col("split") == split)


def prepare_dataset(snippets: DataFrame, seed: int = SEED, rank: bool = True, in_place: bool = False) -> DataFrame:
    """Dedup on all columns, then exact split. Output: row_id, (with ``rank``) rnk,
    split, then the columns of ``snippets``, extra ones included. The rank in the whole
    order costs a second exchange of the rows; the split alone does not. ``in_place``
    removes duplicates without an exchange of rows (``drop_duplicates_in_place``)."""
    unique = drop_duplicates_in_place(snippets) if in_place else drop_duplicates(snippets)
    if rank:
        return split_exact(unique, seed).select("row_id", "rnk", "split", *snippets.columns)
    return split_by_cut(unique, seed).select("row_id", "split", *snippets.columns)


def expected_sizes(n: int) -> tuple[int, int, int]:
    """Plain-Python split sizes, for tests."""
    n_hold = math.ceil(TRAIN_FRACTION_HOLD * n)
    n_val = math.ceil(HOLD_FRACTION_VAL * n_hold)
    return n - n_hold, n_hold - n_val, n_val
