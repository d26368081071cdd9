"""Conditional lines (``#if``): one branch of each, by a table of symbols.

A file is cut into cleaned lines. A running count of ``#if`` less ``#endif`` gives each
conditional line its level; inside (file, level) a running maximum says whether an
earlier branch of the same ``#if`` was taken. A branch that is not taken counts one from
its line on, until the next line of its level; where the running count of such branches
is zero a line stands. So branches nest to any depth, all in windows by file; files
without a ``#if`` are one row in them, and the partitioning by file is kept.

Conditions know names, ``true``, ``false``, ``!``, ``==``, ``!=``, ``&&``, ``||`` and
parentheses; they are rewritten step by step until nothing changes. One that does not
come out as a truth value (a syntax error) is false.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONDITION_OPERATORS, CONDITION_PAIRS, CONDITION_TEXTS, CONDITION_TOKEN_RE, DIRECTIVE_RE
from ..functions.text import clean_lines


def _encoded(condition: Column, symbols: Collection[str]) -> Column:
    """A condition in digits and one-character operators."""
    known = sorted({*symbols, "true"} - {"false"})

    def token(t: Column) -> Column:
        out = F.when(t.isin(*known), "1")
        for word, mark in CONDITION_OPERATORS.items():
            out = out.when(t == word, mark)
        return out.when(t.rlike(r"^[\p{L}_]"), "0").otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(condition, F.lit(CONDITION_TOKEN_RE), 0), token), "")


def _step(e: Column) -> Column:
    for text, value in CONDITION_TEXTS:
        e = F.replace(e, F.lit(text), F.lit(value))
    for pattern, value in CONDITION_PAIRS:
        e = F.regexp_replace(e, pattern, f"$1{value}$2")
    return e


def condition_value(condition: Column, symbols: Collection[str]) -> Column:
    """Whether a condition holds for the given symbols."""
    start = F.struct(_encoded(condition, symbols).alias("e"), F.lit(True).alias("open"))

    def round_(state: Column, _: Column) -> Column:
        further = F.when(state["open"], _step(state["e"])).otherwise(state["e"])
        return F.struct(further.alias("e"), (state["open"] & (further != state["e"])).alias("open"))

    # each round takes at least one character away, or is the last
    return F.aggregate(F.sequence(F.lit(0), F.length(condition)), start, round_, lambda state: state["e"]) == "1"


def active_lines(files: DataFrame, symbols: Collection[str], key: str = "doc_id", code: str = "code", literal_safe: bool = False) -> DataFrame:
    """(key, lines): the cleaned lines that stand for the given symbols, without
    directives. One row a file, an empty array if none stands; null code has none."""
    lines = clean_lines(code, literal_safe=literal_safe)
    has = F.coalesce(F.col(code).rlike(r"# *if"), F.lit(False))
    rows = files.select(key, F.coalesce(lines, F.array().cast("array<string>")).alias("_lines"), has.alias("_has"))
    # files without a conditional line travel as one row
    whole = F.array(F.col("_lines"))
    single = F.transform("_lines", lambda x: F.array(x))
    rows = rows.select(key, F.posexplode_outer(F.when(F.col("_has"), single).otherwise(whole)).alias("i", "part"))
    one = F.when(F.size("part") == 1, F.get("part", F.lit(0)))
    word = F.regexp_extract(one, DIRECTIVE_RE, 1)
    rows = rows.select("*", F.when(word != "", word).alias("word"), F.regexp_extract(one, DIRECTIVE_RE, 2).alias("rest"))
    by_file = Window.partitionBy(key).orderBy("i")
    opened = F.sum(F.when(F.col("word") == "if", 1).when(F.col("word") == "endif", -1).otherwise(0))
    # the level of a conditional: its #endif has already been counted down
    level = opened.over(by_file.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("word") == "endif", 1).otherwise(0)
    holds = F.when(F.col("word").isin("if", "elif"), condition_value(F.col("rest"), symbols)).when(F.col("word") == "else", F.lit(True))
    rows = rows.select("*", F.when(F.col("word").isNotNull(), level).alias("level"), F.coalesce(holds, F.lit(False)).alias("holds"))
    by_level = Window.partitionBy(key, "level").orderBy("i")
    rows = rows.withColumn("which", F.sum(F.when(F.col("word") == "if", 1).otherwise(0)).over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy(key, "level", "which").orderBy("i")
    taken = F.coalesce(F.max(F.col("holds").cast("int")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("which") > 0  # a stray #else or #endif has no branch
    dead = F.when(F.col("word").isin("if", "elif", "else") & inside & (~F.col("holds") | (taken == 1)), 1).otherwise(0)
    rows = rows.withColumn("dead", dead)
    change = F.when(F.col("word").isNotNull(), F.col("dead") - F.coalesce(F.lag("dead").over(earlier), F.lit(0))).otherwise(0)
    rows = rows.withColumn("change", change)
    rows = rows.withColumn("out", F.sum("change").over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    stands = (F.col("out") == 0) & F.col("part").isNotNull()
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(stands, F.struct("i", "part")))).alias("_kept"))
    every = F.flatten(F.transform("_kept", lambda x: x["part"]))
    return found.select(key, F.filter(every, lambda x: ~x.startswith("#")).alias("lines"))
