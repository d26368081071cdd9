"""Operator 11: hard negatives by anchor spanning-tree bounds.

For each anchor and each of its positives (the best rows of its own label), the best
rows of other labels whose scores lie in a window below the positive's. Scores are inner
products of whole-number vectors; ties go to the smaller id.

Rows are dealt by a hash of the row into candidate blocks of about ``BLOCK`` rows, anchors
into slices of about ``SLICE``; a task holds one block and one slice. In it, the anchors
of a slice are cut into trees of at most ``TREE``: a minimum spanning tree over their
distances (Prim). The root is scored against the whole block. Along an edge, the parent's
score plus or minus edge length times the candidate's norm bounds the child's score
(Cauchy and Schwarz); the bounds of a candidate that was not scored at the parent widen
by one more edge. Then

* for positives, a candidate is scored only if its upper bound reaches the k-th best
  lower bound of its anchor's label;
* for negatives, only if its bounds overlap a positive's window and its upper bound
  reaches the k-th best lower bound that surely lies in that window.

Each block yields at most k rows of an anchor or window, and the best of all blocks are
taken in Spark. The number of products grows as anchors times rows, since all rows are
asked for; bounds spare the ones they decide.

Scores are 64-bit and exact: products go through doubles where the squared norms leave
room in 53 bits, else through 64-bit integers.

Defined cases: rows with a null label, a null vector, a null, infinite or NaN component
take no part, and neither do rows whose squared norm reaches 2^55, whose scores times 100
have no 64-bit form; shorter vectors count as filled up with zeros; rows with the same id
are rows of their own (an anchor is no positive of itself); a row without id is no anchor
and comes last among ties; fewer rows than asked for: all there are; a table without
anchors or without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: 100 times the score lies between these multiples of the positive's.
LOW, HIGH = 50, 95
BLOCK = 2048
SLICE = 2048
TREE = 256
MAX_NORM = 2.0**55


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame, doc_id: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """(row, id, label, v, anchor): whole-number vectors of the rows that take part."""
    rows = rows.select(F.col(doc_id).cast("long").alias("id"), label.alias("label"), F.col(vector).alias("x"), anchor.alias("anchor"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    step = lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))
    norm = F.aggregate("x", F.lit(0.0), lambda total, c: total + F.pow(step(c).cast("double"), F.lit(2.0)))
    kept = rows.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).filter(norm < F.lit(MAX_NORM))
    known = F.coalesce(F.col("anchor") & F.col("id").isNotNull(), F.lit(False))
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", step).alias("v"), known.alias("anchor"))


# -- inside a task -----------------------------------------------------------------------


class Rows:
    """Rows of an Arrow table by id (none last), with their vectors as a matrix."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        self.table, lists = table, table.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.v = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
        self.v[np.arange(self.v.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        self.norm = np.sqrt((self.v.astype(float) ** 2).sum(axis=1))
        self.row = table.column("row").to_numpy()
        self.label = table.column("label").to_numpy()

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.v, ((0, 0), (0, width - self.v.shape[1])))


def spanning_tree(v: np.ndarray, norm: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(anchor, parent or -1, edge length) of a minimum spanning tree, parents first."""
    left = np.arange(len(v))
    best, parent = np.full(len(v), np.inf), np.full(len(v), -1)
    best[int(norm.argmin())] = 0
    while len(left):
        at = left[best[left].argmin()]
        yield int(at), int(parent[at]), float(best[at])
        left = left[left != at]
        apart = np.sqrt(((v[left] - v[at]).astype(float) ** 2).sum(axis=1))
        nearer = apart < best[left]
        best[left[nearer]], parent[left[nearer]] = apart[nearer], at


class Scores:
    """What is known of one anchor's scores: low <= score <= high for each candidate."""

    def __init__(self, low: np.ndarray, high: np.ndarray, exact):
        self.low, self.high, self.exact = low, high, exact

    def settle(self, at: np.ndarray) -> None:
        at = at[self.low[at] < self.high[at]]
        if len(at):
            self.low[at] = self.high[at] = self.exact(at)

    def best(self, at: np.ndarray, k: int, least: int | None = None, most: int | None = None) -> np.ndarray:
        """The first k of the candidates ``at`` whose scores lie in the window."""
        if least is not None:
            at = at[(self.high[at] >= least) & (self.low[at] <= most)]
        if len(at) > k:
            self.settle(at[np.argpartition(self.high[at], -k)[-k:]])
            sure = self.low[at] if least is None else self.low[at][(self.low[at] >= least) & (self.high[at] <= most)]
            if len(sure) >= k:
                at = at[self.high[at] >= np.partition(sure, -k)[-k]]
        self.settle(at)
        if least is not None:
            at = at[(self.low[at] >= least) & (self.low[at] <= most)]
        return at[np.argsort(-self.low[at], kind="stable")[:k]]


def scored(anchors: Rows, block: Rows) -> Iterator[tuple[int, Scores]]:
    """Each anchor with bounds of its scores, tree by tree; what is settled before the
    next is asked for narrows the bounds of its children."""
    width = max(anchors.v.shape[1], block.v.shape[1])
    v, x = anchors.widened(width), block.widened(width)
    if anchors.norm.max(initial=0) * block.norm.max(initial=0) < 2.0**52:
        v, x = v.astype(float), x.astype(float)  # exact, and faster

    def exact(a: int):
        return lambda at: (x[at] @ v[a]).astype(np.int64)

    for first in range(0, len(v), TREE):
        known: dict[int, Scores] = {}
        part = anchors.v[first : first + TREE]
        for a, parent, edge in spanning_tree(part, anchors.norm[first : first + TREE]):
            if parent < 0:
                whole = exact(first + a)(np.arange(len(x)))
                known[a] = Scores(whole, whole.copy(), exact(first + a))
            else:
                reach = np.ceil(edge * block.norm * (1 + 1e-9)).astype(np.int64) + 1
                cap = np.ceil(anchors.norm[first + a] * block.norm * (1 + 1e-9)).astype(np.int64) + 1
                above = known[parent]
                known[a] = Scores(np.maximum(above.low - reach, -cap), np.minimum(above.high + reach, cap), exact(first + a))
            yield first + a, known[a]


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    anchors, block = Rows(anchors), Rows(rows)
    of, at, score = [], [], []
    by_label = {y: np.flatnonzero(block.label == y) for y in np.unique(block.label)}
    for a, scores in scored(anchors, block):
        own = by_label.get(anchors.label[a], np.zeros(0, np.int64))
        found = scores.best(own[block.row[own] != anchors.row[a]], POSITIVES)
        of += [a] * len(found)
        at += found.tolist()
        score += scores.low[found].tolist()
    return pa.table({"row": anchors.table.column("row").take(pa.array(of, pa.int64())), "id": block.table.column("id").take(pa.array(at, pa.int64())),
                     "score": pa.array(score, pa.int64())})


def window(score: int) -> tuple[int, int]:
    """The least and the greatest score of a negative to a positive of this score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    anchors, block = Rows(anchors), Rows(rows)
    wanted = anchors.table.column("positives").to_pylist()
    of, place, at, score = [], [], [], []
    by_label = {y: np.flatnonzero(block.label != y) for y in np.unique(anchors.label)}
    for a, scores in scored(anchors, block):
        for i, positive in enumerate(wanted[a]):
            least, most = window(positive["score"])
            if least <= most:
                found = scores.best(by_label[anchors.label[a]], NEGATIVES, least, most)
                of += [a] * len(found)
                place += [i] * len(found)
                at += found.tolist()
                score += scores.low[found].tolist()
    return pa.table({"row": anchors.table.column("row").take(pa.array(of, pa.int64())), "place": pa.array(place, pa.int32()),
                     "id": block.table.column("id").take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64())})


# -- the operator ------------------------------------------------------------------------


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, label: Column, anchor: Column, doc_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    base = C.stored(quantised(rows, doc_id, vector, label, anchor), "negatives-rows")
    n, m = base.agg(F.count("*"), F.count_if("anchor")).first()
    if not m:
        return spark.createDataFrame([], SCHEMA)
    blocks, slices = -(-n // block), -(-m // slice_)

    def every(count: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)

    def dealt(seed: int, count: int, name: str) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count).cast("long")).alias(name)

    keys = ["block", "slice"]
    candidates = base.select("row", "id", "label", "v", dealt(0, blocks, "block"), every(slices, "slice")).groupBy(*keys)
    anchors = base.filter("anchor").select("row", "id", "label", "v")

    def asked(frame: DataFrame):
        return frame.select("*", dealt(1, slices, "slice"), every(blocks, "block")).groupBy(*keys).cogroup(candidates)

    near = asked(anchors).applyInArrow(_positives, "row long, id long, score long")
    positives = _first(near, ["row"], POSITIVES).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    armed = C.stored(anchors.join(positives, "row"), "negatives-anchors")
    found = asked(armed).applyInArrow(_negatives, "row long, place int, id long, score long")
    found = _first(found, ["row", "place"], NEGATIVES).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    out = found.join(armed.select("row", F.col("id").alias("anchor_id"), "positives"), "row")
    positive = F.get("positives", F.col("place"))
    return out.select("anchor_id", positive["id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = C.read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, moved, F.col("vec_id") % 50 == 0)


#: The contract in DuckDB SQL, over all pairs of an anchor and a row.
ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e x ON a.r <> x.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
