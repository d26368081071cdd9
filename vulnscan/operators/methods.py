"""Method extraction (M1-M5) as relational operators.

A file is cut into structural tokens (string/char literals, brackets, ``;``,
arrows, plain runs). Running sums over the tokens of a file give the depths of
parentheses, square and angle brackets and the segment number (a segment ends at a
``{``, ``}`` or ``;`` outside parentheses). A segment's header is what stands outside
all brackets, at any depth: one filter by depth, no rounds of replacements. Running sums over segments give the brace level, and
``lead`` inside (file, level) gives each ``{`` its partner ``}``. A segment
whose text before the delimiter reads as a method signature, and which stands
in the body of a type, is a candidate (so local functions are none);
candidates inside an earlier candidate are dropped (outermost match, M2).
Headers are read with literals masked. Of ``#if`` branches all are read, or the one of
a table of symbols (``directives``). An expression body runs to the ``;`` of
its own brace level.
Segments are then assigned to the method that contains them and glued back.

Every window is partitioned by the file key. ``extract_methods`` hash-
partitions the files by that key once, before the tokens are generated, so
all windows and aggregations downstream reuse that partitioning (no further
exchange). A file is the unit of work: one very large file is one sort
inside one task (it spills, it does not fail).
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    ARROW,
    BRACKETS,
    FIRST_WORD_RE,
    HEADER_MARKS,
    LITERAL_TOKEN_RE,
    METHOD_SIG_RE,
    MODIFIERS_RE,
    NOT_METHOD_WORDS,
    OPERATOR_RE,
    PARSE_TOKEN_RE,
    TYPE_HEADER_RE,
    WS,
)
from ..functions.text import add_line_delimiters, clean_single_line
from ..session import by_key
from .directives import active_lines

_UNBOUNDED_TO_PREV = (Window.unboundedPreceding, -1)
_UNBOUNDED_TO_CUR = (Window.unboundedPreceding, Window.currentRow)


def _ordered_concat(order_col: str, text_col: str) -> Column:
    """Concatenate ``text_col`` of a group in ``order_col`` order."""
    return F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order_col), F.col(text_col)))),
            lambda x: x[text_col],
        ),
        "",
    )


def signature(header: Column) -> Column:
    """A reduced header without pointer and nullable marks and modifiers."""
    bare = F.replace(F.translate(header, HEADER_MARKS, ""), F.lit("::"), F.lit("."))
    return F.regexp_replace(F.btrim(bare, F.lit(WS)), MODIFIERS_RE, "")


def is_method_signature(sig: Column) -> Column:
    """True iff a reduced header declares a method: ``<type> <name>()`` with
    both a type and a name (so constructors, accessors, operators and statements are
    not methods)."""
    first = F.regexp_extract(sig, FIRST_WORD_RE, 1)
    return (
        sig.rlike(METHOD_SIG_RE)
        & ~first.isin(*NOT_METHOD_WORDS)
        & ~sig.rlike(OPERATOR_RE)
    )


def method_name(sig: Column) -> Column:
    return F.regexp_extract(sig, METHOD_SIG_RE, 1)


def parse_tokens(
    files: DataFrame, key: str = "doc_id", code: str = "code", literal_safe: bool = False, symbols: Collection[str] | None = None,
) -> DataFrame:
    """(key, i, tok, off, is_delim, seg, rel, sq, ang) for every structural token: ``rel``
    is the parenthesis depth before it inside its segment; ``sq`` and ``ang`` count the
    square and angle brackets that the file has opened before it outside parentheses."""
    if symbols is None:
        clean = clean_single_line(F.col(code), drop_directives=True, literal_safe=literal_safe)
    else:
        files = active_lines(files, symbols, key, code, literal_safe)
        clean = F.array_join("lines", " ")
    # The outer form: a plain explode makes Catalyst infer a ``size(...) > 0``
    # filter that repeats the whole cleaning and tokenizing expression.
    t = files.select(
        F.col(key),
        F.posexplode_outer(F.regexp_extract_all(clean, F.lit(PARSE_TOKEN_RE), 0)).alias("i", "tok"),
    ).filter(F.col("i").isNotNull())
    prev = Window.partitionBy(key).orderBy("i").rowsBetween(*_UNBOUNDED_TO_PREV)

    def depth(opens: str, closes: str, where: Column | None = None) -> Column:
        delta = F.when(F.col("tok") == opens, 1).when(F.col("tok") == closes, -1).otherwise(0)
        return F.coalesce(F.sum(delta if where is None else F.when(where, delta).otherwise(0)).over(prev), F.lit(0))

    t = t.select("*", depth("(", ")").alias("pdepth"), F.coalesce(F.sum(F.length("tok")).over(prev), F.lit(0)).alias("off"))
    t = t.withColumn("is_delim", F.col("tok").isin("{", "}", ";") & (F.col("pdepth") <= 0))
    # a delimiter leaves the depth as it is, so a segment begins at the depth of the one before
    begin = F.coalesce(F.last(F.when(F.col("is_delim"), F.col("pdepth")), ignorenulls=True).over(prev), F.lit(0))
    t = t.select(
        key, "i", "tok", "off", "is_delim", (F.col("pdepth") - begin).cast("int").alias("rel"),
        F.coalesce(F.sum(F.col("is_delim").cast("int")).over(prev), F.lit(0)).alias("seg"),
    )
    outside = F.col("rel") == 0
    return t.select("*", depth("[", "]", outside).cast("int").alias("sq"), depth("<", ">", outside).cast("int").alias("ang"))


def segments(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per segment: text (delimiter included), offset, delimiter, whether it holds
    an arrow outside parentheses, and its reduced header: the tokens before the arrow or
    delimiter that stand outside attributes, array ranks, type arguments and parameter
    lists, whatever their depth, literals as ``0``."""
    arrow = F.col("tok").endswith(ARROW) & (F.col("rel") == 0)
    g = tokens.groupBy(key, "seg").agg(
        F.array_sort(F.collect_list(F.struct("i", "tok", "rel", "sq", "ang"))).alias("_t"),
        F.min("off").alias("off"),
        F.max(F.when(F.col("is_delim"), F.col("tok"))).alias("delim"),
        F.min(F.when(arrow, F.col("i"))).alias("_arrow"),
        F.max("i").alias("_end"),
    )
    first = F.col("_t")[0]
    last = F.coalesce(F.col("_arrow"), F.col("_end") - 1)

    def kept(x: Column) -> Column:
        level = (x["rel"] == 0) | ((x["rel"] == 1) & (x["tok"] == ")"))
        return level & (x["i"] <= last) & (x["sq"] == first["sq"]) & (x["ang"] == first["ang"]) & ~x["tok"].isin(*BRACKETS)

    def shown(x: Column) -> Column:
        before = x["tok"].substr(F.lit(1), F.length(x["tok"]) - len(ARROW))
        return F.when(x["i"] == F.col("_arrow"), before).when(x["tok"].rlike(LITERAL_TOKEN_RE), "0").otherwise(x["tok"])

    header = F.array_join(F.transform(F.filter("_t", kept), shown), "")
    return g.select(
        key, "seg", F.array_join(F.transform("_t", lambda x: x["tok"]), "").alias("text"), "off", "delim",
        F.col("_arrow").isNotNull().alias("has_arrow"),
        F.when(F.col("delim").isin("{", ";"), signature(header)).alias("sig"),
    )


def brace_levels(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``bd_before`` (brace depth before the segment), ``level`` of its
    brace, and ``partner`` (segment of the matching ``}``; NULL if none)."""
    w = Window.partitionBy(key).orderBy("seg")
    bdelta = F.when(F.col("delim") == "{", 1).when(F.col("delim") == "}", -1).otherwise(0)
    s = segs.withColumn(
        "bd_before", F.coalesce(F.sum(bdelta).over(w.rowsBetween(*_UNBOUNDED_TO_PREV)), F.lit(0))
    )
    s = s.withColumn(
        "level",
        F.when(F.col("delim") == "{", F.col("bd_before") + 1).when(
            F.col("delim") == "}", F.col("bd_before")
        ),
    )
    wl = Window.partitionBy(key, "level").orderBy("seg")
    paired = (F.col("delim") == "{") & (F.lead("delim").over(wl) == "}")
    s = s.withColumn("partner", F.when(paired, F.lead("seg").over(wl)))
    return s.withColumn(
        "partner_stop", F.when(paired, F.lead(F.col("off") + F.length("text")).over(wl))
    )


def in_type_bodies(levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``in_type`` (the innermost open brace is a type's) and ``semi_end`` (the next
    ``;`` of the same brace level). A ``{`` stands twice in its window: as a part of
    the level it is in, and as the opener of the level below."""
    is_type = F.col("sig").rlike(TYPE_HEADER_RE)
    part = F.struct(F.col("bd_before").alias("d"), F.lit(None).cast("boolean").alias("type"))
    opener = F.struct(F.col("level").alias("d"), is_type.alias("type"))
    roles = F.when(F.col("delim") == "{", F.array(part, opener)).otherwise(F.array(part))
    s = levels.select("*", F.explode(roles).alias("_r")).select("*", "_r.d", "_r.type").drop("_r")
    w = Window.partitionBy(key, "d").orderBy("seg")
    semi = F.when((F.col("delim") == ";") & F.col("type").isNull(), F.col("seg"))
    s = s.withColumn("in_type", F.coalesce(F.last("type", ignorenulls=True).over(w.rowsBetween(*_UNBOUNDED_TO_CUR)), F.lit(False)))
    s = s.withColumn("semi_end", F.min(semi).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return s.filter(F.col("type").isNull()).drop("d", "type")


def method_candidates(levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``header`` (signature), ``cand`` and ``cand_end`` (last segment of the candidate)."""
    s = in_type_bodies(levels, key)
    opens, has_arrow = F.col("delim") == "{", F.col("has_arrow")
    end = (
        F.when(F.col("delim") == ";", F.col("seg"))
        .when(opens & has_arrow, F.col("semi_end"))
        .when(opens, F.col("partner"))
    )
    cand = F.coalesce(F.col("in_type") & end.isNotNull() & is_method_signature(F.col("sig")), F.lit(False))
    s = s.withColumn("cand", cand).withColumn("cand_end", F.when(F.col("cand"), end))
    return s.withColumnRenamed("sig", "header").drop("has_arrow", "in_type", "semi_end")


def outermost(cands: DataFrame, key: str = "doc_id") -> DataFrame:
    """M2: keep a candidate only if no earlier candidate contains it; then
    tag every segment with the kept method (``m_start``) it belongs to."""
    w = Window.partitionBy(key).orderBy("seg")
    prev_end = F.max("cand_end").over(w.rowsBetween(*_UNBOUNDED_TO_PREV))
    s = cands.withColumn(
        "kept", F.col("cand") & (prev_end.isNull() | (F.col("seg") > prev_end))
    )
    cur = w.rowsBetween(*_UNBOUNDED_TO_CUR)
    s = s.withColumn("m_start", F.max(F.when(F.col("kept"), F.col("seg"))).over(cur))
    s = s.withColumn("m_end", F.max(F.when(F.col("kept"), F.col("cand_end"))).over(cur))
    return s.withColumn(
        "in_method", F.col("m_start").isNotNull() & (F.col("seg") <= F.col("m_end"))
    )


def assemble_methods(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Glue the segments of each kept method: (key, method_idx, name,
    start_pos, end_pos, method_raw). Offsets are 0-based characters of the
    cleaned one-line text (deviation Q3: characters, not bytes)."""
    g = (
        tagged.filter("in_method")
        .groupBy(key, "m_start")
        .agg(
            _ordered_concat("seg", "text").alias("raw"),
            F.min("off").alias("seg_off"),
            F.max(F.col("off") + F.length("text")).alias("stop"),
            F.max(F.when(F.col("kept"), F.col("header"))).alias("header"),
        )
    )
    method = F.ltrim(F.col("raw"), F.lit(WS))
    w = Window.partitionBy(key).orderBy("m_start")
    return g.select(
        key,
        (F.row_number().over(w) - 1).cast("bigint").alias("method_idx"),
        method_name(F.col("header")).alias("name"),
        (F.col("seg_off") + F.length("raw") - F.length(method)).alias("start_pos"),
        (F.col("stop") - 1).alias("end_pos"),
        method.alias("method_raw"),
    )


def co_partition(files: DataFrame, key: str = "doc_id", code: str = "code") -> DataFrame:
    """Hash-partition files by their key once; all per-file windows reuse it."""
    return by_key(files, key, text=code)


def extract_methods(
    files: DataFrame, key: str = "doc_id", code: str = "code", partition: bool = True, literal_safe: bool = False,
    symbols: Collection[str] | None = None,
) -> DataFrame:
    """M1: every outermost method of every file, in document order. With
    ``literal_safe`` (Q1) comment marks inside literals are left alone. With ``symbols``
    one branch of each ``#if`` is read, that of the given symbols (Q4); without, all are.

    Output: (key, method_idx, name, start_pos, end_pos, method) where
    ``method`` has line delimiters inserted (T6).
    """
    src = co_partition(files.select(key, code), key, code) if partition else files.select(key, code)
    segs = brace_levels(segments(parse_tokens(src, key, code, literal_safe, symbols), key), key)
    m = assemble_methods(outermost(method_candidates(segs, key), key), key)
    return m.select(
        key, "method_idx", "name", "start_pos", "end_pos",
        add_line_delimiters(F.col("method_raw")).alias("method"),
    )


def brace_pairs(files: DataFrame, key: str = "doc_id", code: str = "code") -> DataFrame:
    """M4: (key, level, open_pos, close_pos) for every ``{`` with a partner;
    positions are 0-based characters of the cleaned one-line text."""
    src = co_partition(files.select(key, code), key, code)
    segs = brace_levels(segments(parse_tokens(src, key, code), key), key)
    return segs.filter(F.col("partner").isNotNull()).select(
        key,
        "level",
        (F.col("off") + F.length("text") - 1).alias("open_pos"),
        (F.col("partner_stop") - 1).alias("close_pos"),
    )


def outermost_methods(files: DataFrame, key: str = "doc_id", code: str = "code") -> DataFrame:
    """M2 view: every candidate with its span and whether it was kept."""
    src = co_partition(files.select(key, code), key, code)
    segs = brace_levels(segments(parse_tokens(src, key, code), key), key)
    t = outermost(method_candidates(segs, key), key).filter("cand")
    return t.select(
        key,
        F.col("seg").alias("start_seg"),
        F.col("cand_end").alias("end_seg"),
        method_name(F.col("header")).alias("name"),
        F.col("kept"),
    )


def methods_per_file(files: DataFrame, methods: DataFrame, key: str = "doc_id") -> DataFrame:
    """M5: method count per file; files without methods count 0."""
    counts = methods.groupBy(key).agg(F.count(F.lit(1)).alias("n_methods"))
    return files.select(key).join(counts, key, "left").select(
        key, F.coalesce(F.col("n_methods"), F.lit(0)).cast("bigint").alias("n_methods")
    )
