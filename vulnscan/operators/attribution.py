"""Line attribution (A1-A8) with windows.

Token rows are ``(key..., pos, token, score)``; every window is partitioned
by the item key (a method or a document), so with input partitioned by the
leading key no exchange is added.

The line fold of the original (running sum, emit at a separator or at the
last token if the sum is non-zero, reset) is a gaps-and-islands problem:
``g`` = number of separators strictly before a token; a group ``g`` emits
``sum(score)`` iff the scores of its non-separator tokens, the last token
of the sequence excluded, do not sum to zero; line indices count emitted
groups only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LINE_SEPARATORS, TOP_LINES
from ..session import stored
from .features import global_rank
from .scoring import token_weights


def token_attention(att: DataFrame, keys=("doc_id",)) -> DataFrame:
    """A1: attention received per key position: sum over heads and queries."""
    return att.groupBy(*keys, "k").agg(F.sum("w").alias("score")).select(
        *keys, F.col("k").alias("pos"), F.col("score").cast("bigint").alias("score")
    )


def token_scores(tokens: DataFrame, att_sums: DataFrame, keys=("doc_id",)) -> DataFrame:
    """A3: pair every token with the score at its position (0 if none)."""
    # one stack of both, sorted: a join by position would exchange both again, though they lie
    # together by key
    on = [*keys, "pos"]
    known = att_sums.filter(F.expr(" and ".join(f"`{c}` is not null" for c in on)))
    schema = tokens.select(*on, "token").schema
    t = tokens.select(*on, F.struct("token").alias("_t"), F.lit(None).cast("bigint").alias("_att"))
    s = known.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in on], F.lit(None).cast(t.schema["_t"].dataType).alias("_t"), F.coalesce("score", F.lit(0)).cast("bigint").alias("_att"))
    found = F.collect_list("_att").over(Window.partitionBy(*on))
    both = t.unionAll(s).withColumn("_found", found).filter("_t is not null")
    return both.select(*on, "_t.token", F.explode_outer("_found").alias("_score")).select(
        *on, "token", F.coalesce("_score", F.lit(0)).alias("score")
    )


def mask_special(tokens: DataFrame, keys=("doc_id",), padding: bool = True, score: str = "score") -> DataFrame:
    """A2: first token's score := 0; then the last non-zero score := 0
    (``padding=True``) or the last token's score := 0. All-zero stays zero."""
    w = Window.partitionBy(*keys)
    first_zeroed = F.when(F.col("pos") == F.min("pos").over(w), F.lit(0)).otherwise(F.col(score))
    t = tokens.withColumn(score, first_zeroed.cast(tokens.schema[score].dataType))
    if padding:
        last = F.max(F.when(F.col(score) != 0, F.col("pos"))).over(w)
    else:
        last = F.max("pos").over(w)
    return t.withColumn(
        score, F.when(F.col("pos") == last, F.lit(0)).otherwise(F.col(score)).cast(t.schema[score].dataType)
    )


def is_separator(token: Column) -> Column:
    return token.isin(*LINE_SEPARATORS)


def numbered_lines(tokens: DataFrame, keys=("doc_id",), score: str = "score") -> DataFrame:
    """(keys, line_no, score) for every line whose content scores: ``line_no`` counts
    the lines of the text from 1, those without a score included."""
    w = Window.partitionBy(*keys).orderBy("pos")
    sep = is_separator(F.col("token"))
    t = tokens.select(
        *keys, "pos", "token", F.col(score).alias("_s"),
        F.coalesce(
            F.sum(sep.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("g"),
        (F.col("pos") == F.max("pos").over(Window.partitionBy(*keys))).alias("is_last"),
    )
    content = F.sum(F.when(~is_separator(F.col("token")) & ~F.col("is_last"), F.col("_s")).otherwise(F.lit(0)))
    g = t.groupBy(*keys, "g").agg(content.alias("content"), F.sum("_s").alias("total"))
    return g.filter(F.col("content") != 0).select(*keys, (F.col("g") + 1).alias("line_no"), F.col("total").alias(score))


def line_scores(tokens: DataFrame, keys=("doc_id",), score: str = "score") -> DataFrame:
    """A4: (keys, line_idx, score) for every emitted line; ``line_idx`` counts the emitted ones."""
    wl = Window.partitionBy(*keys).orderBy("line_no")
    return numbered_lines(tokens, keys, score).select(
        *keys, (F.row_number().over(wl) - 1).cast("bigint").alias("line_idx"), score
    )


# ---------------------------------------------------------------------------
# Split form for token tables whose items can be hot (one document holding a
# large share of all rows): no window is partitioned by the item alone.
# ---------------------------------------------------------------------------

_PREV = (Window.unboundedPreceding, -1)
_COMBINE = {"min": F.min, "max": F.max, "sum": F.sum}


def _by_chunk(
    df: DataFrame, keys: list[str], order_col: str, chunk_rows: int,
    item_aggs: dict[str, tuple[Column, str]] | None = None, flag: Column | None = None,
) -> DataFrame:
    """Per-item values without a window or join partitioned by the item alone.

    Rows are cut into chunks of ``chunk_rows`` consecutive ``order_col``
    values. Per chunk, the parts of each item aggregate (``item_aggs``: name ->
    (chunk aggregate, how chunks combine)) and the count of ``flag`` rows are
    pre-aggregated; windows over that small chunk table give the item values
    and the running count before each chunk; each chunk's row of them is stacked
    before the chunk's own rows and read on. Adds the ``item_aggs`` columns and,
    with ``flag``, ``_before`` = number of ``flag`` rows strictly before the row.
    The one window over all rows is partitioned by (item, chunk), so one hot item
    spreads over many tasks; rows that already lie together by item stay there,
    where a join would exchange them. Rows without an item or order are left out.
    """
    item_aggs = item_aggs or {}
    at = [*keys, "_c"]
    d = df.withColumn("_c", F.floor(F.col(order_col) / F.lit(chunk_rows)).cast("bigint"))
    d = d.filter(F.expr(" and ".join(f"`{c}` is not null" for c in at)))
    if flag is not None:
        d = d.withColumn("_f", flag.cast("int"))
    parts = [agg.alias(name) for name, (agg, _) in item_aggs.items()]
    if flag is not None:
        parts.append(F.sum("_f").alias("_n"))
    per_chunk = d.groupBy(*at).agg(*parts)
    whole = Window.partitionBy(*keys)
    cols = [_COMBINE[how](name).over(whole).alias(name) for name, (_, how) in item_aggs.items()]
    if flag is not None:
        run = whole.orderBy("_c").rowsBetween(*_PREV)
        cols.append(F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_base"))
    offs = per_chunk.select(*at, *cols)
    added = [c for c in offs.columns if c not in at]
    row = F.struct(*[c for c in d.columns if c not in at]).alias("_r")
    rows = d.select(*at, row, *[F.lit(None).cast(offs.schema[c].dataType).alias(c) for c in added])
    heads = offs.select(*at, F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"), *added)
    # the head has no order value, so it comes first
    upto = Window.partitionBy(*at).orderBy(F.asc_nulls_first(f"_r.{order_col}")).rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.last(c, ignorenulls=True).over(upto).alias(c) for c in added]
    if flag is not None:
        own = F.coalesce(F.col("_r._f"), F.lit(0))
        seen.append((F.coalesce(F.sum(F.col("_r._f")).over(upto), F.lit(0)) - own).alias("_own"))
    stack = rows.unionAll(heads).select(*at, "_r", *seen).filter("_r is not null")
    out = [F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns] + [F.col(c) for c in item_aggs]
    if flag is not None:
        out.append((F.col("_base") + F.col("_own")).alias("_before"))
    return stack.select(*out)


def mask_special_split(
    tokens: DataFrame, keys=("doc_id",), padding: bool = True, score: str = "score", chunk_rows: int = 1 << 16
) -> DataFrame:
    """A2 like ``mask_special``, from per-item aggregates over chunks."""
    keys = list(keys)
    nz_pos = F.when(F.col(score) != 0, F.col("pos"))
    t = _by_chunk(
        tokens, keys, "pos", chunk_rows,
        {"_first": (F.min("pos"), "min"), "_last": (F.max("pos"), "max"), "_max_nz": (F.max(nz_pos), "max")},
    )
    if padding:
        # after the first is zeroed, the last non-zero is the largest
        # non-zero position unless that is the first itself
        zero = (F.col("pos") == F.col("_first")) | (
            (F.col("pos") == F.col("_max_nz")) & (F.col("_max_nz") != F.col("_first"))
        )
    else:
        zero = (F.col("pos") == F.col("_first")) | (F.col("pos") == F.col("_last"))
    dtype = tokens.schema[score].dataType
    return t.withColumn(score, F.when(zero, F.lit(0)).otherwise(F.col(score)).cast(dtype)).drop(
        "_first", "_last", "_max_nz"
    )


def line_scores_split(
    tokens: DataFrame, keys=("doc_id",), score: str = "score", chunk_rows: int = 1 << 16
) -> DataFrame:
    """A4 like ``line_scores``, without a window or join partitioned by the
    item alone: separator counts and line numbers are two-level prefix sums. Tokens
    are read once, into the pieces of the lines that lie in a chunk; the pieces are
    stored, numbered by the separators of the chunks before, and put together."""
    keys = list(keys)
    at = [*keys, "_c"]
    sep = is_separator(F.col("token"))
    chunk = F.floor(F.col("pos") / F.lit(chunk_rows)).cast("bigint").alias("_c")
    t = tokens.select(*keys, chunk, "pos", sep.alias("_sep"), F.col(score).alias("_s"))
    within = Window.partitionBy(*at)
    t = t.select(
        "*", F.max("pos").over(within).alias("_end"),
        F.coalesce(F.sum(F.col("_sep").cast("int")).over(within.orderBy("pos").rowsBetween(*_PREV)), F.lit(0)).alias("_g"),
    )
    ends = F.col("pos") == F.col("_end")
    pieces = stored(t.groupBy(*at, "_g").agg(
        F.sum(F.when(~F.col("_sep") & ~ends, F.col("_s")).otherwise(F.lit(0))).alias("_inner"),
        # of the chunk's last token: no content if it is the item's last, too
        F.sum(F.when(~F.col("_sep") & ends, F.col("_s")).otherwise(F.lit(0))).alias("_tail"),
        F.sum("_s").alias("_all"), F.sum(F.col("_sep").cast("int")).alias("_n"), F.max("_end").alias("_end"),
    ), "line-pieces")
    whole = Window.partitionBy(*keys)
    offs = pieces.groupBy(*at).agg(F.sum("_n").alias("_n"), F.max("_end").alias("_e")).select(
        *at, F.max("_e").over(whole).alias("_last"),
        F.coalesce(F.sum("_n").over(whole.orderBy("_c").rowsBetween(*_PREV)), F.lit(0)).alias("_base"),
    )
    content = F.col("_inner") + F.when(F.col("_end") == F.col("_last"), F.lit(0)).otherwise(F.col("_tail"))
    g = pieces.join(offs, at).groupBy(*keys, (F.col("_base") + F.col("_g")).alias("g")).agg(
        F.sum(content).alias("content"), F.sum("_all").alias("total"))
    lines = g.filter(F.col("content") != 0)
    idx = _by_chunk(lines, keys, "g", chunk_rows, flag=F.lit(True))
    return idx.select(*keys, F.col("_before").cast("bigint").alias("line_idx"), F.col("total").alias(score))


def top_lines_split(
    lines: DataFrame, keys=("doc_id",), k: int = TOP_LINES, score: str = "score", chunk_rows: int = 1 << 16
) -> DataFrame:
    """A5 + A6 like ``top_lines(rank_lines(..))``, without a window over all
    lines of an item: the top ``k`` of every (item, chunk of line indices),
    then the top ``k`` of those at most ``k`` per chunk. The order (score
    desc, line asc) is total, so the result is exact."""
    keys = list(keys)
    order = [F.desc(score), F.asc("line_idx")]
    d = lines.withColumn("_c", F.floor(F.col("line_idx") / F.lit(chunk_rows)).cast("bigint"))
    w1 = Window.partitionBy(*keys, "_c").orderBy(*order)
    cand = d.repartition(*keys, "_c").withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    ranked = cand.withColumn("rnk", F.row_number().over(w2).cast("bigint"))
    return top_lines(ranked, keys, k)


def rank_lines(lines: DataFrame, keys=("doc_id",), score: str = "score") -> DataFrame:
    """A5: rank 1.. by score descending; ties keep the lower line first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("line_idx"))
    return lines.withColumn("rnk", F.row_number().over(w).cast("bigint"))


def rank_lines_split(lines: DataFrame, keys=("doc_id",), score: str = "score") -> DataFrame:
    """A5 like ``rank_lines``, without a window over all lines of an item: the rows'
    ranks in one range-partitioned sort by item and order, less the item's first."""
    keys = list(keys)
    ranked = global_rank(lines, [*[F.asc(k) for k in keys], F.desc(score), F.asc("line_idx")], "_rank")
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, keys).withColumn("rnk", F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")


def top_lines(ranked: DataFrame, keys=("doc_id",), k: int = TOP_LINES) -> DataFrame:
    """(keys, vul_lines): the first ``k`` line indices in rank order,
    comma-joined (a string column, so results hash alike everywhere)."""
    top = ranked.filter(F.col("rnk") <= k)
    lst = F.transform(
        F.array_sort(F.collect_list(F.struct("rnk", "line_idx"))), lambda x: x["line_idx"].cast("string")
    )
    return top.groupBy(*keys).agg(F.array_join(lst, ",").alias("vul_lines"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, wherever a lambda refers to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def array_top_lines(tokens: Column, k: int = TOP_LINES) -> Column:
    """A2 (without padding), A4, A5 and A6 inside one row: ``tokens`` is an array of
    (sep, score) in order; gives the first ``k`` lines as (line_no, line_idx, score) in
    rank order. Lines are slices between separators, so the work is linear in the tokens
    and needs neither a window nor a join."""
    def masked(t: Column, n: Column) -> Column:
        return F.transform(t, lambda x, i: F.struct(x["sep"].alias("sep"), F.when((i == 0) | (i == n - 1), 0.0).otherwise(x["score"]).alias("score")))

    def bounds(t: Column, n: Column) -> Column:
        ends = F.filter(F.transform(t, lambda x, i: F.when(x["sep"] & (i < n - 1), i)), lambda i: i.isNotNull())
        return F.concat(F.array(F.lit(-1)), ends, F.array(n - 1))

    def lines(m: Column, b: Column) -> Column:
        def line(end: Column, j: Column) -> Column:
            start = F.get(b, j)
            zero = F.struct(F.lit(0.0).alias("content"), F.lit(0.0).alias("score"))

            def add(a: Column, x: Column) -> Column:
                return F.struct((a["content"] + F.when(x["sep"], 0.0).otherwise(x["score"])).alias("content"), (a["score"] + x["score"]).alias("score"))

            total = F.aggregate(F.slice(m, start + 2, end - start), zero, add)
            return _let(total, lambda s: F.struct(s["content"].alias("content"), (j + 1).cast("bigint").alias("line_no"), s["score"].alias("score")))

        return F.filter(F.transform(F.slice(b, 2, F.size(b)), line), lambda x: x["content"] != 0)

    def top(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["score"]).alias("o"), x["line_no"], i.cast("bigint").alias("line_idx"), x["score"])))
        return F.transform(F.slice(order, 1, k), lambda x: F.struct(x["line_no"], x["line_idx"], x["score"]))

    def of(t: Column) -> Column:
        return _let(F.size(t), lambda n: _let(masked(t, n), lambda m: _let(bounds(t, n), lambda b: _let(lines(m, b), top))))

    return F.when(F.size(tokens) > 0, _let(tokens, of))


def linear_token_scores(tokens: DataFrame, weights: DataFrame, token_col: str = "token") -> DataFrame:
    """Token importance = its weight in the linear scorer, clamped at 0."""
    t = token_weights(tokens, weights, token_col)
    return t.withColumn("score", F.greatest(F.col("w"), F.lit(0.0))).drop("w")


def ranked_top_lines(tokens: DataFrame, keys=("doc_id",), padding: bool = True, k: int = TOP_LINES) -> DataFrame:
    """A2 -> A4 -> A5 -> A6 on token rows."""
    return top_lines(rank_lines(line_scores(mask_special(tokens, keys, padding), keys), keys), keys, k)
