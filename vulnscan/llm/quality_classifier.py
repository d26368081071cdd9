"""Operator 6: quality classifier on random-indexing word vectors.

Word vectors: every word type falls into one of ``BUCKETS`` slots by its hash, and every
slot has a fixed sparse ternary index vector. A first pass counts the slots; a second adds
to each slot's context vector the index vectors of the words around it, frequent ones
damped by the root of their share. Tasks project, Spark adds integer vectors in a table of
fixed size; the mean context is taken off, so that what all words share does not count.

A document is pooled to the damped mean and spread of its words' unit vectors, the mean
and spread of the index vectors of its words' shapes (runs of upper case, lower case,
digits and marks), its length and share of distinct words. A two-layer
network in numpy is fitted on at most ``MAX_LABELLED`` labelled rows (lowest id
hashes first), with early stopping and temperature scaling on a fifth of them.

Held out: rows whose crc32 of the id's text leaves 2 by 4 are never learnt from.

Defined cases: null and empty texts pool to zeros and get a score like any other;
very long texts are pooled whole; rows with the same id are scored each; labels
that are null are not learnt from, repeated ones once (the lower label); without
labels of both kinds every score is the share of label 1 (0.5 without any); an empty
table gives no rows; other columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 17
SHAPES = 512
DIMENSIONS = 32
SPAN = 2
#: Share of all words from which a slot is damped, and the steps of a whole weight.
FREQUENT = 1e-3
STEPS = 64
#: Texts whose words a task numbers at a time, and words that it projects at a time.
ROWS = 1024
CHUNK = 100_000
#: Rows of a sum that a task hands over at a time: both sides hold a batch as Arrow buffers.
HANDED = 8192
MAX_LABELLED = 20_000
HIDDEN = 32
KEEP_SCORE = 0.7
_KINDS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
_RUN = re.compile(rb"([^Aa0])\1+")


#: Each byte as the mark of its kind; what is no letter or digit stays itself.
_KIND_TABLE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
CACHED = 200_000


def word_slot(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word.translate(C.FOLD_TABLE)) % BUCKETS


class Slots(dict):
    """Slot of each word; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = word_slot(word)
        return value

    def of(self, distinct: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))


class Shapes(dict):
    """Shape of a word given as the kinds of its bytes; a bounded cache, as words of equal
    kinds share an entry."""

    def __missing__(self, kinds: bytes) -> int:
        shape = kinds
        for pattern, mark in _KINDS:
            shape = pattern.sub(mark, shape)
        shape = _RUN.sub(rb"\1+", shape)[:16]
        if len(self) >= CACHED:
            self.clear()
        self[kinds] = value = xxhash.xxh3_64_intdigest(shape) % SHAPES
        return value


class Types(dict):
    """Slot and shape of each word as slot * SHAPES + shape; a bounded cache."""

    def __init__(self):
        super().__init__()
        self.shapes = Shapes()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = word_slot(word) * SHAPES + self.shapes[word.translate(_KIND_TABLE)]
        return value

    def of(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Slots and shapes of the words of each text."""
        codes, distinct, sizes = C.word_codes(texts)
        both = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        slots, shapes = (both // SHAPES)[codes], (both % SHAPES)[codes]
        ends = np.cumsum(sizes)[:-1]
        return list(zip(np.split(slots, ends), np.split(shapes, ends), strict=True)) if len(sizes) else []


def index_vectors(rows: int = SHAPES) -> np.ndarray:
    """Ternary: four entries of +-1 a row."""
    rng = np.random.default_rng(6)
    drawn = rng.random((rows, DIMENSIONS), np.float32)
    # a part at a time: all places at once are eight bytes an entry
    places = np.concatenate([drawn[a : a + HANDED].argpartition(4, axis=1)[:, :4].astype(np.uint8) for a in range(0, rows, HANDED)])
    out = np.zeros((rows, DIMENSIONS), np.int8)
    np.put_along_axis(out, places.astype(np.intp), rng.choice([-1, 1], (rows, 4)).astype(np.int8), axis=1)
    return out


def _rows(used: np.ndarray, sums: np.ndarray, names) -> Iterator[pa.RecordBatch]:
    """The used slots with their sums, in batches."""
    for a in range(0, max(1, len(used)), HANDED):
        part = used[a : a + HANDED]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c) for c in np.ascontiguousarray(sums[part].T))], names=["slot", *names])


def _summed(docs: DataFrame, text: str, task, names: list[str]) -> np.ndarray:
    """Sums by slot of the whole numbers that tasks yield; at most BUCKETS rows."""
    made = docs.select(text).mapInArrow(lambda batches: C.trimmed(task(batches)), "slot long, " + ", ".join(f"{n} long" for n in names))
    got = made.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((BUCKETS, len(names)), np.int64)
    for i, n in enumerate(names):
        out[got.column("slot").to_numpy(), i] = got.column(n).to_numpy()
    return out


def slot_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Words of each slot in all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, n = Slots(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                codes, distinct, _ = C.word_codes(batch.column(0).slice(at, ROWS))
                np.add.at(n, slots.of(distinct), np.bincount(codes, minlength=len(distinct)))
        used = np.flatnonzero(n)
        yield from _rows(used, n[:, None], ["n"])

    return _summed(docs, text, count, ["n"])[:, 0]


def weights(counts: np.ndarray) -> np.ndarray:
    """min(1, root of FREQUENT / share), at least one step, in whole steps."""
    share = counts / max(1, counts.sum())
    return np.maximum(1, np.rint(STEPS * np.sqrt(FREQUENT / np.maximum(share, FREQUENT)))).astype(np.int64)


def context_table(docs: DataFrame, text: str = "text", counts: np.ndarray | None = None) -> np.ndarray:
    """Context vectors of all slots, from all documents, less the mean context."""
    shared = docs.sparkSession.sparkContext.broadcast(weights(slot_counts(docs, text) if counts is None else counts).astype(np.int16))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Slots()
        # the row behind the last is no word's: it stands between texts
        index = np.zeros((BUCKETS + 1, DIMENSIONS + 1), np.int16)
        # at most STEPS; sums of 2 * SPAN fit
        np.multiply(index_vectors(BUCKETS), shared.value[:, None], out=index[:BUCKETS, :-1])
        index[:BUCKETS, -1] = 1  # counts neighbours
        near = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                codes, distinct, sizes = C.word_codes(batch.column(0).slice(at, ROWS))
                places = np.arange(len(codes)) + SPAN * np.repeat(np.arange(len(sizes)), sizes)
                slots = np.full(len(codes) + SPAN * len(sizes), BUCKETS)
                slots[places] = words.of(distinct)[codes]
                for a in range(0, len(slots), CHUNK):
                    part = slots[max(0, a - SPAN) : a + CHUNK + SPAN]
                    vectors = index[part]
                    around = np.zeros_like(vectors)
                    for d in range(1, SPAN + 1):
                        around[d:] += vectors[:-d]
                        around[:-d] += vectors[d:]
                    own = slice(min(a, SPAN), min(a, SPAN) + min(CHUNK, len(slots) - a))
                    part, around = part[own], around[own]
                    order = np.argsort(part, kind="stable")
                    part = part[order]
                    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    sums = np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)
                    known = part[starts] < BUCKETS
                    near[part[starts[known]]] += sums[known]
        used = np.flatnonzero(near[:, -1])
        yield from _rows(used, near, names)

    names = [*(f"c{i}" for i in range(DIMENSIONS)), "n"]
    near = _summed(docs, text, project, names).astype(float)
    return near[:, :-1] - near[:, -1:] * (near[:, :-1].sum(axis=0) / max(1.0, near[:, -1].sum()))


def unit(table: np.ndarray) -> np.ndarray:
    return table / np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-12)


class Pooler:
    """Document vectors, from the slots' unit vectors and weights."""

    width = 4 * DIMENSIONS + 2

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        (self.words, self.weights), self.shapes, self.types = table, index_vectors().astype(float), Types()

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text."""
        found = [v for at in range(0, len(texts), ROWS) for v in self.types.of(pa.array(texts[at : at + ROWS], pa.string()))]
        return np.array([self._pooled(*v) for v in found]).reshape(-1, self.width)

    def _pooled(self, slots: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out, n = np.zeros(self.width), len(slots)
        if n:
            which, times = np.unique(slots, return_counts=True)
            weight = times * self.weights[which]
            weight = weight / weight.sum()
            distinct = len(which)
            parts = [(weight, self.words[which])]
            which, times = np.unique(shapes, return_counts=True)
            parts.append((times / n, self.shapes[which]))
            for i, (share, vectors) in enumerate(parts):
                mean = share @ vectors
                out[2 * i * DIMENSIONS : (2 * i + 1) * DIMENSIONS] = mean
                out[(2 * i + 1) * DIMENSIONS : (2 * i + 2) * DIMENSIONS] = np.sqrt(np.maximum(share @ vectors**2 - mean**2, 0))
            out[-2:] = np.log1p(n) / 10, distinct / min(n, BUCKETS)
        return out


def _pooling(table):
    @F.pandas_udf("array<double>")
    def pooled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from C.trimmed(made(batches))

    def made(batches):
        pooler = Pooler(table.value)
        for texts in batches:
            yield pd.Series(pooler.pool(texts.tolist()).tolist(), dtype="object")

    return pooled.asNondeterministic()


class Network:
    """Two layers (tanh, logistic) with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, seed: int = 6):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, learnt = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[learnt].mean(axis=0), x[learnt].std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, best, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], (np.inf, p), 0
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(learnt), max(1, len(learnt) // 256)):
                step += 1
                h = np.tanh(x[part] @ p[0] + p[1])
                error = (_logistic(h @ p[2] + p[3]) - y[part]) / max(1, len(part))
                back = np.outer(error, p[2]) * (1 - h**2)
                for i, g in enumerate((x[part].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error, error.sum(keepdims=True))):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g**2
                    p[i] = p[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            loss = _loss(np.tanh(x[held] @ p[0] + p[1]) @ p[2] + p[3], y[held]) if len(held) else 0.0
            if loss < best[0] or not len(held):
                best = (loss, list(p))
        self.p = best[1]
        z = np.tanh(x[held] @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]
        grid = np.exp(np.linspace(-1.5, 1.5, 61))
        self.temperature = float(min(grid, key=lambda t: _loss(z / t, y[held]))) if len(held) else 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return _logistic((h @ self.p[2] + self.p[3]) / self.temperature)


class Constant:
    """Stands in where there are not labels of both kinds."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z, y) -> float:
    p = np.clip(_logistic(z), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def held_out(doc_id: Column) -> Column:
    """Null ids count as held out: nothing can be learnt from them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED):
    """(unit word vectors with the slots' weights, fitted model)."""
    counts = slot_counts(docs, text)
    table = unit(context_table(docs, text, counts)).astype(np.float32), (weights(counts) / STEPS).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).filter(F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")  # at most `limit` rows
    rows = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text"))
    sample = sorted((r[0], r[1], r[2]) for r in rows.select("_id", "_y", _pooling(shared)("_text")).toLocalIterator())
    y = np.array([r[1] for r in sample], float)
    if len(set(y.tolist())) < 2:
        return shared, Constant(float(y.mean()) if len(y) else 0.5)
    return shared, Network(np.array([r[2] for r in sample]), y)


def scorer(table, model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from C.trimmed(made(batches))

    def made(batches):
        pooler = Pooler(table.value)
        for texts in batches:
            yield pd.Series(np.round(model.score(pooler.pool(texts.tolist())), 9))

    return score.asNondeterministic()


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    table, model = fit(docs, labels, doc_id, text, **kw)
    out = docs.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), scorer(table, model)(F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= KEEP_SCORE, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents that are predicted good, with all their columns."""
    table, model = fit(docs, labels, doc_id, text, **kw)
    held = {c: f"_keep_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()])
    rows = rows.withColumn("_score", scorer(table, model)(F.col(held[text])))
    return rows.filter(F.col("_score") >= KEEP_SCORE).select(*[F.col(h).alias(c) for c, h in held.items()])


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.documents(spark, sf_dir), C.read_table(spark, sf_dir, "labels"))
