"""T1-T7 against the plain-Python model; hazards H1-H3."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from models import PY_WS, add_line_delimiters, clean_multi_line, clean_single_line, strip_comments
from vulnscan.functions import text as T
from vulnscan.functions.constants import WS

ALPHA = "ab /*\n\r\t\"x;{}\u0085 \xa0　#"


def _spark_map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    out = df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()
    return [r.o for r in out]


def test_whitespace_set_equals_python():
    assert WS == PY_WS
    assert len(WS) == 29
    assert "﻿" not in WS


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=ALPHA, max_size=40), min_size=1, max_size=80))
def test_cleaning_matches_model(spark, values):
    assert _spark_map(spark, values, T.strip_comments) == [strip_comments(v) for v in values]
    assert _spark_map(spark, values, T.clean_single_line) == [clean_single_line(v) for v in values]
    assert _spark_map(spark, values, T.clean_multi_line) == [clean_multi_line(v) for v in values]
    assert _spark_map(spark, values, T.add_line_delimiters) == [add_line_delimiters(v) for v in values]


EDGE_COMMENTS = [
    "a // b\rc\nd",
    "a // b c\nd",
    "a // b\u0085c\nd",
    'x="http://y";\nz',
    "/* a */ b // c /* d\ne */ f",
    "/*/ a */b",
    "/* open",
    "/***/x/* ** */y",
]


def test_comment_edge_cases(spark):
    assert _spark_map(spark, EDGE_COMMENTS, T.strip_comments) == [strip_comments(v) for v in EDGE_COMMENTS]
    # line comments run to "\n" only, not to "\r", U+0085 or U+2028 (H2)
    assert strip_comments("a // b\rc\nd") == "a \nd"
    # literal-unaware: a URL in a string is cut
    assert strip_comments('x="http://y";\nz') == 'x="http:\nz'


def test_long_block_comment_does_not_overflow(spark):
    # H1: a 100,000-character block comment
    s = "a/*" + ("x\n" * 50_000) + "*/b"
    assert _spark_map(spark, [s], T.strip_comments) == ["ab"]


def test_strip_uses_python_whitespace(spark):
    values = [c + "x" + c for c in WS] + ["﻿x", "", "  \n \t\n"]
    assert _spark_map(spark, values, T.clean_single_line) == [clean_single_line(v) for v in values]
    assert _spark_map(spark, [None], T.clean_single_line) == [None]


def test_tab_and_cr_deleted_not_spaced(spark):
    assert _spark_map(spark, ["int\tx\r\n"], T.clean_single_line) == ["intx"]


def test_token_markers(spark):
    df = spark.createDataFrame([(["Ġa", "ĉ", "b"],)], "t array<string>")
    assert df.select(T.normalise_tokens("t").alias("o")).first().o == ["a", "Ċ", "b"]
    lines = df.select(T.token_lines(T.normalise_tokens("t")).alias("o")).first().o
    assert lines == ["a", "b"]


def test_decode_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff\xfe"),)], "b binary")
    assert [r.o for r in df.select(T.decode_utf8("b").alias("o")).collect()] == ["ok", None]
