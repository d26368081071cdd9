"""Operator 13: near duplicates by SimHash, with pivot distance tables.

A document's fingerprint has 64 bits: bit b is set if it is set in over half of the
XXH64 values (seed 42) of its shingles, repeats included. Documents link if their
fingerprints differ in at most ``DISTANCE`` bits; components of links are the classes.

Each distinct fingerprint takes part once, however many documents have it. Groups are
made by the pigeonhole rule: if 64 bits are cut into r parts, two linked fingerprints
agree on some r - DISTANCE of them, so every choice of r - DISTANCE parts is a key.
Groups above ``GROUP`` rows are split by longer keys (more parts); with the last number
of parts a group has at most 2^16 members, as so few bits are left free.

Inside a group, the pivot tables act: the Hamming distances of its members to
``PIVOTS`` reference fingerprints are computed once and the members are sorted by the
first; two members whose distances to any reference differ by more than ``DISTANCE``
cannot link (triangle inequality). So a member is held only against the ones next to it
in that order, pairs are discarded by their largest coordinate difference, and the
survivors are verified bit by bit. A group yields a spanning forest of its links, never
its pairs. Pivots alone give no groups of use: for unrelated fingerprints one distance
lets 57 % of the pairs pass; hence the keys before them.

Defined cases: null, empty or blank texts have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; long texts are read whole, in steps
of bounded size; rows with the same id are rows of their own; rows without id get their
class's smallest id (null if none has one); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .jaccard_join import connected

WIDTH = 4
SEED = 42
BITS = 64
DISTANCE = 4
PIVOTS = 16
#: Rows of a group beyond which longer keys split it, the numbers of parts, and the rows
#: that a task holds at a time.
GROUP = 2048
PARTS = (5, 8, 16)
CHUNK = 1 << 16
#: Reference fingerprints: hashes of the numbers from 0.
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(PIVOTS)], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = text.encode().translate(C.FOLD_TABLE).split() if text else []
    if not words:
        return 0
    joined, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[at + k - 1 : at + k - 1 + CHUNK].tolist(), strict=True)
        values = np.array([hashed(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(width: int):
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from C.trimmed(pd.Series([fingerprint(t, width) for t in texts], dtype="int64") for texts in batches)

    return made.asNondeterministic()


# -- keys --------------------------------------------------------------------------------


def masks(parts: int, distance: int) -> list[int]:
    """Bits of every choice of ``parts - distance`` parts, as signed 64-bit numbers."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(parts)]
    made = [sum(chosen) for chosen in combinations(part, parts - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in made]


def keyed(rows: DataFrame, parts: int, distance: int) -> DataFrame:
    """(fp, key) for every key of a fingerprint. Equal hashes of different keys only put
    more rows into a group."""
    chosen = F.explode(F.array(*[F.lit(m) for m in masks(parts, distance)])).alias("m")
    return rows.select("fp", chosen).select("fp", F.xxhash64("m", F.col("fp").bitwiseAND(F.col("m"))).alias("key"))


# -- inside groups -----------------------------------------------------------------------


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of each class) with the links (a, b) added."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least of its class) that span the classes of whole groups."""
    bits = fp.view(np.uint64)
    table = np.bitwise_count(bits[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.lexsort((bits, table[:, 0], key))
    key, bits, table = key[order], bits[order], table[order]
    label, first, step = np.arange(len(key)), np.arange(len(key)), 0
    while len(first):
        step += 1
        first = first[first + step < len(key)]
        second = first + step
        # in the order of the first distance, the first that is too far ends a member's search
        near = (key[first] == key[second]) & (table[second, 0] - table[first, 0] <= distance)
        first, second = first[near], second[near]
        open_ = label[first] != label[second]
        a, b = first[open_], second[open_]
        for part in np.array_split(np.arange(1, PIVOTS), 3):
            near = (np.abs(table[a][:, part] - table[b][:, part]) <= distance).all(axis=1)
            a, b = a[near], b[near]
        linked = np.bitwise_count(bits[a] ^ bits[b]) <= distance
        if linked.any():
            label = merged(label, a[linked], b[linked])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return bits[moved].view(np.int64), bits[label[moved]].view(np.int64)


def _forests(distance: int):
    """Over rows sorted by key: holds whole groups, about CHUNK rows of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) >= CHUNK else 0
            if whole:
                yield _links(*forest(key[:whole], fp[:whole], distance))
                key, fp = key[whole:], fp[whole:]
        yield _links(*forest(key, fp, distance))

    return lambda batches: C.trimmed(run(batches))


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fingerprints: DataFrame, distance: int = DISTANCE, parts=PARTS, group: int = GROUP) -> DataFrame:
    """(a, b): links that span the components of the distinct fingerprints ``fp``."""
    found, rows = None, fingerprints.select("fp")
    for n in parts:
        keys = keyed(rows, n, distance)
        last = n == parts[-1]
        if not last:
            large = C.stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("key"), "simhash-large")
            last = large.isEmpty()
        if not last:
            rows = C.stored(keys.join(large, "key", "left_semi").select("fp").distinct(), "simhash-split")
            keys = keys.join(large, "key", "left_anti")
        grouped = keys.select("key", "fp").repartition("key").sortWithinPartitions("key")
        here = grouped.mapInArrow(_forests(distance), "a long, b long")
        found = here if found is None else found.union(here)
        if last:
            return found
    return found


# -- the operator ------------------------------------------------------------------------


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE, **limits) -> DataFrame:
    """id, fp (the fingerprint as a signed number) and component_id for each row."""
    rows = C.stored(docs.select(F.col(doc_id).alias("id"), _fingerprints(width)(F.col(text)).alias("fp")), "simhash-rows")
    distinct = C.stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    edges = C.stored(links(distinct, distance, **limits), "simhash-links")
    table = distinct.filter("n > 1").select("fp", "least")
    if not edges.isEmpty():
        comps = connected(edges, "simhash").toDF("fp", "comp")
        met = C.stored(distinct.join(comps, "fp"), "simhash-met")
        least = C.stored(met.groupBy("comp").agg(F.min("least").alias("of_all")), "simhash-least")
        table = table.join(met, "fp", "left_anti").unionByName(met.join(least, "comp").select("fp", F.col("of_all").alias("least")))
    # a table of its own: joined to the aggregates in place, a hot fingerprint could not be split
    table = C.stored(table.withColumn("known", F.lit(True)), "simhash-table")
    out = rows.join(table, "fp", "left")
    return out.select("id", "fp", F.when(F.col("known"), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    out = components(docs, doc_id, text, **kw)
    return out.select(F.col("id").alias(doc_id), as_text(F.col("fp")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))
