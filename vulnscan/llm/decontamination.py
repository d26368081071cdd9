"""Operator 8: benchmark decontamination by a broadcast set of test n-grams.

Benchmark items are normalised to lower-cased alphanumeric words and cut into
windows of 13 words (an item of fewer words is one window). The hashes of all
windows form a sorted array that is broadcast; every training window of the
same width is probed against it, each hit is verified word by word, and the
words inside verified occurrences are marked.

Size rule: the window set is broadcast only after counting its windows
(``MAX_BROADCAST_WINDOWS``); a larger benchmark goes through a shuffle join of
window hashes instead (``hits_by_join``), with the same results.

Defined cases: null or empty text has no words, no hits and is clean; a null or
wordless item has no window; repeated rows are judged row by row; repeated item
ids are listed once; an empty benchmark leaves every document clean; columns
other than id and text are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
#: About 150 bytes each with their words: at most about 150 MB are broadcast.
MAX_BROADCAST_WINDOWS = 1_000_000
HITS = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<start:long,end:long>>"


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    width = min(window, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if words else []


class WindowIndex:
    """All benchmark windows by width: sorted hashes, and the words and items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.items: dict[tuple[bytes, ...], list] = {}
        for item_id, text in items:
            for w in item_windows(C.alnum_words(text), window):
                self.items.setdefault(w, []).append(item_id)
        by_width: dict[int, list[tuple[bytes, ...]]] = {}
        for w in self.items:
            by_width.setdefault(len(w), []).append(w)
        hasher = C.WordHash()
        self.widths = {}
        for width, found in by_width.items():
            flat = hasher.of([x for w in found for x in w]).reshape(-1, width)
            self.widths[width] = np.unique(_row_hash(flat))
        #: A fixed table over the top bits; most windows are dismissed by it.
        self.screens = {k: _screen(v) for k, v in self.widths.items()}

    def find(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Verified occurrences as (start, end) and the items they belong to."""
        spans, items = [], set()
        for width, known in self.widths.items():
            if len(words) < width:
                continue
            w = C.windows(hashes, width)
            at = np.flatnonzero(self.screens[width][w >> np.uint64(44)])
            at = at[known[np.minimum(np.searchsorted(known, w[at]), len(known) - 1)] == w[at]]
            for i in at.tolist():
                owners = self.items.get(tuple(words[i : i + width]))
                if owners:
                    spans.append((i, i + width))
                    items.update(owners)
        return sorted(spans), items


def _row_hash(rows: np.ndarray) -> np.ndarray:
    width = rows.shape[1]
    return np.concatenate([C.windows(r, width) for r in rows]) if len(rows) else np.zeros(0, np.uint64)


def _screen(known: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[known >> np.uint64(44)] = True
    return table


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted({str(x) for x in items if x is not None})).encode()).hexdigest()


def _annotator(index):
    @F.pandas_udf(HITS)
    def annotate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from C.trimmed(found(batches))

    def found(batches):
        known, hasher = index.value, C.WordHash()
        for texts in batches:
            rows = []
            for text in texts:
                words = C.alnum_words(text)
                spans, items = known.find(words, hasher.of(words))
                spans = merged(spans)
                rows.append((len(words), sum(e - s for s, e in spans), len(items - {None}), _digest(items),
                             [{"start": s, "end": e} for s, e in spans]))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "spans"])

    return annotate.asNondeterministic()  # one evaluation: no copy is pushed into filters


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def benchmark_windows(benchmark: DataFrame, window: int, item: str, text: str) -> int:
    """Number of windows of all items (an upper bound: words are counted as runs)."""
    n = F.size(F.array_remove(F.split(C.fold(F.col(text)), C.ALNUM_SEPARATORS), ""))
    n = F.when(n == 0, 0).otherwise(F.greatest(n - (window - 1), F.lit(1)))
    return benchmark.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", limit: int = MAX_BROADCAST_WINDOWS,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, then the columns of ``keep``, then n_words, n_hit, n_items,
    items_sha256, spans (merged word intervals) and contaminated, for each row."""
    if benchmark_windows(benchmark, window, item_id, item_text) <= limit:
        items = [tuple(r) for r in benchmark.select(item_id, item_text).toLocalIterator()]
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, window))
        out = docs.select(doc_id, *keep, _annotator(index)(F.col(text)).alias("_h"))
    else:
        out = hits_by_join(docs, benchmark, window, doc_id, text, item_id, item_text, keep)
    return out.select(doc_id, *keep, "_h.*", contaminated(F.col("_h.n_hit"), F.col("_h.n_words")).alias("contaminated"))


def hits_by_join(docs, benchmark, window, doc_id, text, item_id, item_text, keep=()) -> DataFrame:
    """The same annotation for a benchmark of any size: windows of both sides meet
    in an equi-join on (width, hash, the words themselves)."""
    rows = C.stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
                                F.col(text).alias("_text"), *keep), "decontamination")

    def words(column):
        return F.array_remove(F.split(C.fold(F.col(column)), C.ALNUM_SEPARATORS), "")

    def window_at(width):
        return lambda i: F.array_join(F.slice("_w", i + 1, width), " ")

    def window_rows(df, widths, *cols):
        made = []
        for width in widths:
            n = F.size("_w") - (width - 1)
            at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            # the windows' own words, not the text's, go with each place
            keys = F.transform(at, window_at(width))
            made.append(df.select(*cols, F.posexplode(keys).alias("pos", "key"), F.lit(width).alias("width")).select(*cols, "pos", "width", "key"))
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return out

    items = benchmark.select(F.col(item_id).alias("_item"), words(item_text).alias("_w")).withColumn("_n", F.size("_w"))
    widths = range(1, window + 1)
    known = window_rows(items, widths, "_item", "_n")
    known = known.filter(F.col("width") == F.least(F.col("_n"), F.lit(window))).select("_item", "width", "key").distinct()
    used = [r[0] for r in known.select("width").distinct().collect()]  # at most `window` rows
    if not used:
        used = [window]
    places = window_rows(rows.select("_row", words("_text").alias("_w")), used, "_row")
    found = places.join(known, ["width", "key"]).groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("width")).alias("e")))).alias("_s"),
        F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def unite(spans: pd.Series) -> pd.Series:
        return spans.map(lambda v: [{"start": a, "end": b} for a, b in merged([(x["s"], x["e"]) for x in (v if v is not None else [])])])

    out = rows.join(found, "_row", "left").withColumn("_u", unite("_s"))
    n_hit = F.aggregate("_u", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    none = F.array().cast("array<string>")
    return out.select(F.col("_id").alias(doc_id), *keep, F.struct(
        F.size(words("_text")).cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(F.coalesce("_items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("_items", none), ","), 256).alias("items_sha256"),
        F.col("_u").alias("spans")).alias("_h"))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    kept = tuple(c for c in docs.columns if c != kw.get("doc_id", "doc_id"))
    held = {c: f"_keep_{i}" for i, c in enumerate(kept)}
    text = kw.pop("text", "text")
    named = docs.select(kw.get("doc_id", "doc_id"), *[F.col(f"`{c}`").alias(h) for c, h in held.items()])
    out = judge(named, benchmark, text=held[text], keep=tuple(held.values()), **kw).filter(~F.col("contaminated"))
    by = {h: c for c, h in held.items()}
    back = {c: F.col(held[c]).alias(c) for c in kept}
    assert len(by) == len(kept)
    return out.select(*[back.get(c, F.col(c)) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(C.documents(spark, sf_dir), C.read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The contract in DuckDB SQL: windows of each item's own width, joined to the
#: documents' windows of that width; hit words are distinct positions.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
