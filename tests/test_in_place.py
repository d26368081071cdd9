"""X2 and E2 in place: rows are pinned, hashes and places move, texts do not."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vulnscan.operators import dataset as X
from vulnscan.session import pin_rows, place_of

SCHEMA = "`some_text` string, y int, `odd name` string"


def _rows(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([None, "", "a", "b" * 5000, f"t{i % 37}"]), rnd.choice([None, 0, 1]), rnd.choice([None, "1:", "x"])) for i in range(n)]


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def one_group(cols):
    return F.lit(7).cast("long")


def few_groups(cols):
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols]) % 3


@pytest.mark.parametrize("group", [X.row_group, one_group, few_groups])
def test_equals_a_set_also_when_hashes_collide(spark, group):
    rows = _rows(700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _sorted(X.drop_duplicates_in_place(df, group).collect()) == _sorted(set(rows))


def test_one_group_of_copies_and_more_rows_than_a_word(spark):
    df = spark.range(0, 5000, 1, 3).select((F.col("id") % 2).cast("string").alias("t"))
    assert _sorted(X.drop_duplicates_in_place(df).collect()) == [("0",), ("1",)]
    df = spark.range(0, 5000, 1, 3)
    assert X.drop_duplicates_in_place(df).distinct().count() == X.drop_duplicates_in_place(df).count() == 5000


def test_empty_table_and_equal_values_spelt_differently(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.drop_duplicates_in_place(empty).collect() == []
    df = spark.createDataFrame([(0.0, [1, None]), (-0.0, [1, None]), (math.nan, None), (math.nan, None), (None, [])], "x double, a array<int>")
    assert X.drop_duplicates_in_place(df).count() == df.dropDuplicates().count() == 3


def test_neighbouring_columns_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "1:b"), ("a1:", "b"), ("-", None), (None, "-")], "a string, b string")
    assert X.drop_duplicates_in_place(df, one_group).count() == 4


def test_bits_mark_the_rows_named(spark):
    rows = pin_rows(spark.range(0, 1000, 1, 4))
    some = rows.filter("id % 7 = 3").select("_row")
    bits = X.row_bits(rows, {"hit": some, "none": some.limit(0)})
    back = rows.join(bits, "_part").withColumn("_n", place_of("_row")[1])
    assert sorted(r.id for r in back.filter(X.has_bit("hit", "_n")).collect()) == [i for i in range(1000) if i % 7 == 3]
    assert back.filter(X.has_bit("none", "_n")).count() == 0


def _exchanges(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [p for p in df._jdf.queryExecution().explainString(mode).split("\n\n") if "Exchange" in p.split("\n")[0]]


@pytest.mark.parametrize("broadcast", [True, False])
def test_texts_stay_in_place(spark, broadcast):
    """Also where the bits are too large to broadcast: the pinned table's layout is used."""
    df = spark.createDataFrame(_rows(300), SCHEMA)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = X.drop_duplicates_in_place(df)
        exchanges = _exchanges(spark, out)
        assert not any("some_text" in p for p in exchanges)
        assert broadcast or exchanges
        split = X.prepare_dataset(df, rank=False, in_place=True)
        assert not any("some_text" in p for p in _exchanges(spark, split))
        want = X.prepare_dataset(df, rank=False)
        assert _sorted(split.collect()) == _sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_table_name_is_left(spark):
    X.drop_duplicates_in_place(spark.range(10)).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pinned_")]
