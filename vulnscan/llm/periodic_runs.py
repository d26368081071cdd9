"""Operator 12: periodic runs of words, by an enhanced suffix array.

A run is a stretch of words with smallest period q that is at least ``max(LEAST,
REPEATS * q)`` words long and that no neighbouring word extends. For the texts that a
task holds at a time:

* Suffixes are sorted by doubling: ranks of 1, 2, 4, .. words, each round only for the
  suffixes that are still tied. The rank tables of all rounds are kept.
* Common prefixes of neighbours in the suffix array come from the rank tables.
* One pass with a stack gives the bounds of the LCP interval of every split. No tree
  is built: an interval is its bounds, its depth and its splits.
* Branching-tandem test: in an interval of depth p, each suffix i of all children but the
  largest looks up ISA[i + p] and ISA[i - p]; if that lies in the interval and in another
  child, two equal words of length p stand side by side and the square cannot be moved
  one word to the right.
* Such a square is rotated to the left as far as it goes (by the rank tables, in steps of
  falling powers of two), which gives the whole stretch. Stretches of equal bounds are
  one run, of their smallest period.

Words of different texts get different numbers, so nothing crosses a text's end.

Defined cases: null, empty and blank texts have no words and no runs; rows with the same
id are treated each; a long text is treated whole (its rank tables take 4 bytes a word
and round, and rounds grow with the logarithm of its longest repeat); null ids are
kept (and in ``planted`` left as they are); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEAST = 6
REPEATS = 4
#: Words that a task holds at a time, beyond the last text.
HELD_WORDS = 150_000

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


# -- suffix array ------------------------------------------------------------------------


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, with one number of its own after each text, places of the
    texts' first words). Equal numbers: the same word of the same text."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    out = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for at, words in zip(first.tolist(), texts, strict=True):
        out[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
    out += 1
    out[first + sizes] = 0
    return out + np.repeat(np.arange(len(texts)), sizes + 1) * (len(known) + 1), first


def _heads(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], values[1:] != values[:-1]])


def suffixes(numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by 1, 2, 4, .. words; the last are all different)."""
    n, span = len(numbers), 1
    order = np.argsort(numbers, kind="stable")
    head = _heads(numbers[order])
    rank = np.zeros(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks = [rank]
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied):
        at = order[tied]
        # a tied suffix has ``span`` words before its text's end, which is never tied
        both = rank[at].astype(np.int64) * n + rank[at + span]
        by = np.argsort(both, kind="stable")
        order[tied] = at = at[by]
        head = _heads(both[by])
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
        ranks.append(rank)
        tied = tied[~(head & np.append(head[1:], True))]
        span *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Equal words of each suffix and the one before it in the array; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b, shared = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        shared += (ranks[level][a + shared] == ranks[level][b + shared]).astype(np.int64) << level
    out[at] = shared
    return out


def interval_bounds(depths: list[int]) -> tuple[list[int], list[int]]:
    """For each place with a common prefix before it (a split): the first place of its
    LCP interval and the place after its last."""
    low, high, stack = [0] * len(depths), [len(depths)] * len(depths), []
    for k, depth in enumerate(depths):
        while stack and depths[stack[-1]] > depth:
            high[stack.pop()] = k
        if stack and depths[stack[-1]] == depth:
            low[k] = low[stack[-1]]
        else:
            low[k] = stack[-1] if stack else 0
        if depth:
            stack.append(k)
        else:
            stack = [k]  # ends every interval
    return low, high


def squares(order: np.ndarray, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every square that cannot be moved to the right."""
    none = np.zeros(0, np.int64)
    split = np.flatnonzero(depth)
    if not len(split):
        return none, none
    low, high = (np.array(x)[split] for x in interval_bounds(depth.tolist()))
    at, p = split, depth[split]
    # intervals: splits of equal bounds; children: from a split to the next
    by = np.argsort(low * (len(order) + 1) + high, kind="stable")
    low, high, at, p = low[by], high[by], at[by], p[by]
    head = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    which = head.cumsum() - 1
    heads = np.flatnonzero(head)
    lows, highs, ps = low[heads], high[heads], p[heads]
    # children in order: for each interval the one at its low end, then one a split
    place = np.arange(len(at)) + which + 1
    starts = np.zeros(len(at) + len(heads), np.int64)
    starts[place] = at
    firsts = heads + np.arange(len(heads))
    starts[firsts] = lows
    of = np.zeros(len(starts), np.int64)
    of[firsts] = 1
    of = of.cumsum() - 1
    ends = np.append(starts[1:], 0)
    lasts = np.append(firsts[1:], len(starts)) - 1
    ends[lasts] = highs
    sizes = ends - starts
    largest = np.maximum.reduceat(sizes, firsts)
    place = np.where(sizes == largest[of], np.arange(len(sizes)), len(sizes))
    small = np.ones(len(sizes), bool)
    small[np.minimum.reduceat(place, firsts)] = False
    starts, ends, of, sizes = starts[small], ends[small], of[small], sizes[small]
    total = int(sizes.sum())
    child = np.repeat(np.arange(len(sizes)), sizes)
    i = order[starts[child] + np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    period, child_of = ps[of][child], of[child]
    found = []
    for j, ok in ((i + period, np.ones(total, bool)), (i - period, i >= period)):
        r = rank[np.where(ok, j, 0)]
        ok = ok & (r >= lows[child_of]) & (r < highs[child_of]) & ((r < starts[child]) | (r >= ends[child]))
        found.append((np.minimum(i, j)[ok], period[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """For each text its runs, rows (start, length, period), by start and period."""
    empty = np.zeros((0, 3), np.int64)
    if not any(texts):
        return [empty] * len(texts)
    numbers, first = numbered(texts)
    order, ranks = suffixes(numbers)
    at, period = squares(order, ranks[-1], common_prefixes(order, ranks))
    start = at.copy()
    for level in range(len(ranks) - 1, -1, -1):
        back = start - (1 << level)
        same = back >= 0
        back = np.where(same, back, 0)
        same &= ranks[level][back] == ranks[level][np.minimum(back + period, len(numbers) - 1)]
        start = np.where(same, back, start)
    end = at + 2 * period
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(least, repeats * period)
    start, end, period = start[keep], end[keep], period[keep]
    text = np.searchsorted(first, start, side="right") - 1
    rows = np.stack([start - first[text], end - start, period], axis=1)
    return np.split(rows, np.searchsorted(text, np.arange(1, len(texts))))


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(change.cumsum()[:-1] == 0).tolist()])


# -- the operator ------------------------------------------------------------------------


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and the collapsed text."""
    id_field = T.StructField(doc_id, docs.schema[doc_id].dataType)
    schema = T.StructType([id_field, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def treat(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs(texts, least, repeats)
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        columns = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=[f.name for f in RUN.fields])
        short = pa.array([collapsed(w, f).decode() for w, f in zip(texts, found, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), columns), short],
            names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at, texts, held = batch.column(1).cast(pa.binary()), 0, [], 0
            for i, value in enumerate(values):
                texts.append((value.as_py() or b"").split())
                held += len(texts[-1]) + 1
                if held >= HELD_WORDS or i + 1 == len(values):
                    yield treat([batch.column(0).slice(at, len(texts))], texts)
                    at, texts, held = i + 1, [], 0

    return docs.select(doc_id, text).mapInArrow(lambda batches: C.trimmed(run(batches)), schema)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with the contract's periodic tails: where h = crc32 of the id's text
    is divisible by 10, word i from a = g % n on is word a + (i - a) % p of the text, with
    g = h div 10 and p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(doc_id), F.col(text).alias("_text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    n, g = F.size("_w").cast("long"), F.col("_g")
    rows = rows.select("*", F.when(n > 0, g % n).alias("_a"))
    rows = rows.select("*", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).alias("_p"))

    def word(i: Column) -> Column:
        a = F.col("_a")
        return F.element_at("_w", (1 + F.when(i < a, i).otherwise(a + (i - a) % F.col("_p"))).cast("int"))

    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return rows.select(doc_id, F.when(F.col("_a").isNotNull(), tail).otherwise(F.col("_text")).alias(text))


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns from ``find_runs``."""
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    rows = found.withColumn("_best", F.get(longest, F.lit(0)))
    return rows.select(
        doc_id, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"), F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(find_runs(planted(C.documents(spark, sf_dir))))
