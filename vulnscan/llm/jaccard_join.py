"""Operator 3: n-gram Jaccard join by T-occurrence search.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at
least 3/4. The result is the component of every document under these links.

1. *Sets.* Each text becomes its sorted distinct shingle hashes; equal sets (copies)
   become one node, named by 128 bits of its set.
2. *Screen.* The sets' prefixes (in hash order) are indexed. For linked sets x and y,
   at least ``least_shared(|x|)`` elements of x's prefix also lie in y's, so a node
   with fewer prefix elements that any other node has cannot link: most nodes end here.
   Postings travel as packed arrays, one row for each task and hash bucket; a bucket
   answers with counts. No pairs are made.
3. *Contraction.* Nodes that share a min-hash are compared with two seeds of their
   group, and verified links contract to components (a large group of near copies
   shrinks to a few at a cost linear in its size).
4. *T-occurrence search.* A link that is still missing joins two components, so at
   least 3/4 of either side's elements occur in another component. The nodes for
   which that holds (again counted by buckets, exactly) are put in index blocks;
   each queries the blocks with which its prefix (rarest elements first) shares an
   element. In a block, DivideSkip merges the short inverted lists, probes the long
   ones by binary search, and keeps the nodes that reach the required overlap. One
   link for each query and component is enough.

Every step is exact for the links' components up to 64-bit hash collisions.

Defined cases: null, empty and wordless texts have the empty set and link with
nothing, not even each other; fewer than five words are one shingle; repeated rows
and copies share a component; a null id takes part, but the component's id is the
smallest id that is not null; an empty table gives no rows; other columns are
ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
#: Postings of a bucket (about 12 bytes each), and of a task before it hands them on.
BUCKET_POSTINGS = 400_000
FLUSH = 400_000
BANDS = (4, 8)
BLOCK_NODES = 256
QUERY_CHUNK = 512
#: Postings up to which the short lists go through a heap.
HEAP_MERGE = 64
#: Bits of the filter that spares the second reading of the texts most work.
FILTER_BITS = 1 << 22
SET = "n long, node binary, s long, prefix binary"


def shingles(text: str | None, hasher: C.WordHash, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode().translate(C.FOLD_TABLE).split() if text else []
    return np.unique(C.windows(hasher.of(words), min(width, len(words)))) if words else np.zeros(0, np.uint64)


def needed(n):
    """Least overlap of a set of size n with any set it links to: ceil(3/4 n)."""
    return -(-3 * n // 4)


def overlap(n, m):
    """Least overlap of linked sets of sizes n and m: 100 * i >= 75 * (n + m - i)."""
    return -(-3 * (n + m) // 7)


def prefix_length(n: int) -> int:
    """The first n - needed(n) + k elements hold k common ones, k = max(1, n // 8)."""
    return n - needed(n) + max(1, n // 8)


def least_shared(n: Column) -> Column:
    """Prefix elements that a set shares with a linked one, whose size is at least
    needed(n): the lesser of both k."""
    small = F.ceil(n * 3 / 4)
    return F.greatest(F.lit(1), F.floor(small / 8))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) < needed(max(len(x), len(y))) or not len(x) or not len(y):
        return False
    i = len(np.intersect1d(x, y, assume_unique=True))
    return i >= overlap(len(x), len(y))


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sets():
    @F.pandas_udf(SET)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from C.trimmed(made(batches))

    def made(batches):
        hasher = C.WordHash()
        for texts in batches:
            rows = []
            for text in texts:
                found = shingles(text, hasher)
                node = _node(found)
                rows.append((len(found), node, int.from_bytes(node[:8], "little", signed=True), found[: prefix_length(len(found))].tobytes()))
            yield pd.DataFrame(rows, columns=["n", "node", "s", "prefix"])

    return make.asNondeterministic()


# -- postings by buckets ------------------------------------------------------------


def _posted(rows: DataFrame, values: str, group: str, buckets: int) -> DataFrame:
    """Packed postings: for each bucket the low halves of the hashes, and for each run of
    one node its name, its group's name, and the run's length."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held, seen = [], 0, set()
        for batch in batches:
            for name, owner, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                name = name.as_py()
                if name in seen:  # copies in this task
                    continue
                if len(seen) < 100_000:
                    seen.add(name)
                found = np.frombuffer(data.as_py(), np.uint64)
                pending.append((name, owner.as_py(), found))
                held += len(found)
                if held >= FLUSH:
                    yield _packed(pending, buckets)
                    pending, held = [], 0
        if pending:
            yield _packed(pending, buckets)

    return rows.select("s", F.col(group).alias("g"), values).mapInArrow(lambda batches: C.trimmed(pack(batches)), "bucket int, low binary, s binary, g binary, runs binary")


def _packed(pending, buckets: int) -> pa.RecordBatch:
    sizes = np.array([len(p[2]) for p in pending])
    every = np.concatenate([p[2] for p in pending])
    bucket = ((every >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    owner = np.repeat(np.arange(len(pending)), sizes)[order]
    bucket, low = bucket[order], every[order].astype(np.uint32)
    names = np.array([p[0] for p in pending], np.int64)
    groups = np.array([p[1] for p in pending], np.int64)
    out = []
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        starts = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
        runs = np.diff(np.r_[starts, b - a]).astype(np.uint32)
        of = owner[a:b][starts]
        out.append((int(bucket[a]), low[a:b].tobytes(), names[of].tobytes(), groups[of].tobytes(), runs.tobytes()))
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "low", "s", "g", "runs"])


def shared_counts(rows: DataFrame, values: str, group: str, postings: int) -> DataFrame:
    """(s, shared): for each node the number of its values that occur in another group."""
    buckets = max(64, -(-postings // BUCKET_POSTINGS))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, t: np.frombuffer(b"".join(frame[c]), t)
        low, runs = join("low", np.uint32), join("runs", np.uint32)
        node, owner = np.repeat(join("s", np.int64), runs), np.repeat(join("g", np.int64), runs)
        order = np.lexsort((node, owner, low))
        low, node, owner = low[order], node[order], owner[order]
        del order
        first = np.ones(len(low), bool)  # of its value
        first[1:] = low[1:] != low[:-1]
        other = first.copy()  # of its group in its value
        other[1:] |= owner[1:] != owner[:-1]
        again = np.zeros(len(low), bool)  # a copy's posting from another task
        again[1:] = ~first[1:] & (node[1:] == node[:-1])
        starts = np.flatnonzero(first)
        several = np.add.reduceat(other, starts, dtype=np.int32) > 1 if len(starts) else np.zeros(0, bool)
        counted = np.repeat(several, np.diff(np.append(starts, len(low)))) & ~again
        names, n = np.unique(node[counted], return_counts=True)
        del low, runs, node, owner, first, other, again, counted
        C.trim()
        return pd.DataFrame({"s": names, "shared": n.astype(np.int64)})

    packed = _posted(rows, values, group, buckets)
    return packed.groupBy("bucket").applyInPandas(count, "s long, shared long").groupBy("s").agg(F.sum("shared").alias("shared"))


# -- components -----------------------------------------------------------------------


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): components of an edge list (a, b), for the nodes on it. Each round
    moves every node to its least neighbour and keeps the edges between different
    labels; rounds are written and read again."""
    edges = C.stored(edges.filter("a <> b").distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = C.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), f"{name}-least")
        left, right = least.toDF("a", "la"), least.toDF("b", "lb")
        edges = C.stored(edges.join(left, "a").join(right, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"{name}-edges")
        if labels is None:
            labels = least
        else:
            moved = least.toDF("comp", "to")
            labels = C.stored(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{name}-labels")
    return edges.sparkSession.createDataFrame([], "node binary, comp binary") if labels is None else labels


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    @F.pandas_udf("boolean")
    def links(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y, strict=True)], dtype=bool)

    x = sets.select(F.col("node").alias("a"), F.col("found").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return pairs.join(y, "b").join(x, "a").filter(links("x", "y")).select("a", "b")


def _bands(first: int, last: int):
    seeds = np.random.default_rng(3).integers(1, 1 << 63, last, dtype=np.uint64)[first:last]

    @F.pandas_udf("array<long>")
    def least(found: pd.Series) -> pd.Series:
        return pd.Series([[int(C.mix(x ^ k).min().view(np.int64)) for k in seeds] for x in (np.frombuffer(f, np.uint64) for f in found)])

    return least


def _contracted(sets: DataFrame, comps: DataFrame | None, first: int, last: int, name: str) -> DataFrame:
    """Links between nodes and the two seeds of their min-hash groups, where they are not
    in one component already."""
    keys = sets.select("node", "n", F.posexplode(_bands(first, last)("found")).alias("band", "key"))
    if comps is not None:
        keys = keys.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        keys = keys.withColumn("comp", F.col("node"))
    keys = C.stored(keys, f"{name}-keys")
    seed = F.struct("node", "n", "comp")
    seeds = keys.groupBy("band", "key").agg(F.min(seed).alias("low"), F.max(seed).alias("high")).filter("low.node <> high.node")
    # a table of its own: joined to the aggregate in place, a hot group could not be split
    seeds = C.stored(seeds, f"{name}-seeds")
    met = keys.join(seeds, ["band", "key"])
    pairs = met.select("node", "n", "comp", F.explode(F.array("low", "high")).alias("z"))
    near = 4 * F.least("n", "z.n") >= 3 * F.greatest("n", "z.n")
    pairs = pairs.filter((F.col("comp") != F.col("z.comp")) & near).select(F.col("node").alias("a"), F.col("z.node").alias("b"))
    return _verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)


# -- T-occurrence search -----------------------------------------------------------------


class Block:
    """Inverted lists over the sets of one index block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.values, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = owner[order]

    def search(self, query: np.ndarray) -> np.ndarray:
        """Sets that link with the query: DivideSkip."""
        if not len(query) or not len(self.values):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        at = at[self.values[at] == query]
        least = needed(len(query))
        if len(at) < least:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.count[at], kind="stable")]
        longest = int(self.count[at[-1]])
        n_long = min(int(least / (0.01 * log2(max(2, longest)) + 1)), least - 1)
        lists = [self.owner[self.first[i] : self.first[i] + self.count[i]] for i in at]
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        # merge of the short lists: candidates reach the threshold less the long lists
        docs, seen = _merged(short)
        keep = seen >= least - n_long
        docs, seen = docs[keep], seen[keep]
        for i, s in enumerate(long):  # binary probes; hopeless candidates are dropped on the way
            if not len(docs):
                break
            place = np.minimum(np.searchsorted(s, docs), len(s) - 1)
            seen = seen + (s[place] == docs)
            keep = seen >= least - (n_long - i - 1)
            docs, seen = docs[keep], seen[keep]
        return docs[seen >= overlap(len(query), self.sizes[docs])]


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of sorted lists and how many lists hold each: a heap merge, or,
    where that would take long, one sort of the lists' runs."""
    if sum(map(len, lists)) > HEAP_MERGE:
        return np.unique(np.concatenate(lists), return_counts=True)
    found, counts = [], []
    for doc in heapq.merge(*[s.tolist() for s in lists]):
        if found and found[-1] == doc:
            counts[-1] += 1
        else:
            found.append(doc)
            counts.append(1)
    return np.array(found, np.int64), np.array(counts, np.int64)


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of one block's queries, one for each query and component."""
    index, queries = frame[frame.role == 0], frame[frame.role == 1]
    block = Block([np.frombuffer(f, np.uint64) for f in index.found])
    nodes, comps, out = list(index.node), list(index.comp), []
    for node, comp, found in zip(queries.node, queries.comp, queries.found, strict=True):
        met = set()
        for i in block.search(np.frombuffer(found, np.uint64)).tolist():
            if comps[i] != comp and comps[i] not in met:
                met.add(comps[i])
                out.append((node, nodes[i], comp, comps[i]))
    del block, index, queries
    C.trim()
    return pd.DataFrame(out, columns=["a", "b", "ca", "cb"])


def _remaining(sets: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Edges (ca, cb) between components for all links that contraction left out."""
    named = sets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = C.stored(named.withColumn("g", F.xxhash64("comp")), "jaccard-named")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = shared_counts(named, "found", "g", total)
    open_ = C.stored(named.join(counts, "s").filter(F.col("shared") >= F.ceil(F.col("n") * 3 / 4)).drop("shared"), "jaccard-open")
    n_open = open_.count()
    if not n_open:
        return None
    postings = C.stored(open_.mapInArrow(_exploded, "node binary, comp binary, n long, h long"), "jaccard-postings")
    spread = postings.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("df")).filter("c0 <> c1").select("h", "df")
    # the elements of one component only come first in the order and match nothing: the
    # prefix has |rest| - needed + 1 of the others, rarest first
    sized = C.stored(postings.join(spread, "h"), "jaccard-spread")
    size = sized.groupBy("node").agg(F.count("*").alias("rest"))
    reach = sized.join(size, "node").filter(F.col("rest") >= F.ceil(F.col("n") * 3 / 4))
    parts = reach.groupBy("node", "n", "rest").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))  # one document's elements
    prefix = parts.select("node", F.explode(F.slice("o", F.lit(1), (F.col("rest") - F.ceil(F.col("n") * 3 / 4) + 1).cast("int"))).alias("e")).select("node", "e.h")
    blocks = max(1, n_open // BLOCK_NODES)
    placed = open_.select("node", "comp", "n", F.pmod(F.xxhash64(_bands(0, 1)("found")), F.lit(blocks)).alias("block"),
                          F.pmod(F.xxhash64("node"), F.lit(1 << 20)).alias("spot"))
    # a block that many similar nodes fall into is split further
    crowd = placed.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK_NODES)).alias("split"))
    placed = placed.join(crowd, "block").select("node", "comp", F.concat_ws("-", "block", F.pmod("spot", "split")).alias("block"))
    placed = C.stored(placed, "jaccard-blocks")
    home = prefix.join(placed, "node")
    in_block = home.groupBy("h", "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    asks = home.select("node", "comp", "h").join(in_block, "h").filter((F.col("comp") != F.col("c0")) | (F.col("comp") != F.col("c1")))
    asks = asks.select("node", "block").distinct()
    load = asks.groupBy("block").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("chunks"))
    load = C.stored(load, "jaccard-load")
    asked = asks.join(load, "block").select("node", "block", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(1).alias("role"))
    held = placed.join(load, "block").select("node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    rows = held.unionByName(asked).join(open_.select("node", "comp", "found"), "node")
    links = rows.groupBy("block", "chunk").applyInPandas(_search, "a binary, b binary, ca binary, cb binary")
    return links.select("ca", "cb").distinct().toDF("a", "b")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        for node, comp, n, found in zip(rows["node"], rows["comp"], rows["n"], rows["found"], strict=True):
            values = np.frombuffer(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(values), pa.binary()), pa.array([comp] * len(values), pa.binary()),
                                              pa.array(np.full(len(values), n)), pa.array(values)], names=["node", "comp", "n", "h"])


# -- the operator ----------------------------------------------------------------------------


def _full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, s, n, found) of the wanted nodes, from their texts. A filter of fixed size
    over the ids spares the other texts most of the work; the join is exact."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("v"))
    table = np.zeros(FILTER_BITS // 32, np.int64)
    for w, v in words.toLocalIterator():  # at most FILTER_BITS / 32 rows
        table[w] = v
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("n long, node binary, s long, found binary")
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from C.trimmed(made(batches))

    def made(batches):
        hasher, bits = C.WordHash(), shared.value
        for places, texts in batches:
            rows = []
            for b, text in zip(places, texts, strict=True):
                if not bits[b >> 5] >> (b & 31) & 1:
                    rows.append((0, None, None, None))
                    continue
                found = shingles(text, hasher)
                node = _node(found)
                rows.append((len(found), node, int.from_bytes(node[:8], "little", signed=True), found.tobytes()))
            yield pd.DataFrame(rows, columns=["n", "node", "s", "found"]).astype({"s": "Int64"})

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("_text")).select(make.asNondeterministic()(bit, "_text").alias("_s")).select("_s.*")
    rows = rows.filter(F.col("node").isNotNull() & (F.col("n") > 0)).join(wanted.select("node"), "node", "left_semi")
    return C.stored(rows.groupBy("node").agg(F.first("s").alias("s"), F.first("n").alias("n"), F.first("found").alias("found")), "jaccard-full")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (size of the set), node and comp (names of the set and of its component) and
    component_id for each row."""
    rows = docs.select(F.col(doc_id).alias("id"), _sets()(F.col(text)).alias("_s")).select("id", "_s.*")
    rows = C.stored(rows, "jaccard-sets")
    some = rows.filter("n > 0")
    postings = some.agg(F.coalesce(F.sum(F.length("prefix") / 8), F.lit(0))).first()[0]
    counts = shared_counts(some, "prefix", "s", int(postings))
    nodes = C.stored(some.groupBy("node", "s").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies")), "jaccard-nodes")
    wanted = C.stored(nodes.join(counts, "s").filter(F.col("shared") >= least_shared(F.col("n"))).select("node", "id"), "jaccard-wanted")
    sets = _full_sets(docs, doc_id, text, wanted)

    edges, comps, first = None, None, 0
    for i, n in enumerate(BANDS):
        found = C.stored(_contracted(sets, comps, first, first + n, f"jaccard-{i}"), "jaccard-found")
        edges = found if edges is None else edges.union(found)
        comps = connected(edges, "jaccard")
        first += n
    rest = _remaining(sets, comps)
    if rest is not None:
        moved = connected(rest, "jaccard-rest").toDF("comp", "to")
        every = sets.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        comps = C.stored(every.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "jaccard-comps")

    named = nodes.join(comps, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"), "copies", F.col("comp").isNotNull().alias("met"))
    least = named.filter("met").groupBy("comp").agg(F.min("id").alias("least"))
    table = named.filter("met or copies > 1").join(least, "comp", "left").select("node", "comp", F.coalesce("least", "id").alias("least"))
    out = rows.select("id", "n", "node").join(C.stored(table, "jaccard-table"), "node", "left")
    return out.select("id", "n", "node", F.coalesce("comp", "node").alias("comp"),
                      F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return components(docs, doc_id, text).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with its smallest id, with all columns. The
    decision is a row's own: one id may stand on rows of several components and of no
    text. Rows that repeat an id within a component count as one document; a row without
    id stays only as the one row of a component without ids."""
    found = C.stored(components(docs, doc_id, text), "jaccard-components")
    goes = F.col("id") != F.col("component_id")
    by_id = found.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.count_if(goes).alias("gone"))
    kept = docs.join(by_id.filter("gone = rows").select(F.col("id").alias(doc_id)), doc_id, "left_anti")
    several = C.stored(by_id.filter("rows > 1 and gone < rows").select("id"), "jaccard-several")
    if not several.isEmpty():  # ids that do not decide: by id and set
        heads = found.filter(~goes & (F.col("n") > 0)).join(several, "id", "left_semi")
        heads = heads.groupBy("id", "comp").agg(F.min("node").alias("_node")).select(F.col("id").alias("_id"), "_node", F.col("comp").alias("_comp"))
        ids = several.select(F.col("id").alias(doc_id))
        unsure = kept.join(ids, doc_id, "left_semi").withColumn("_set", _sets()(F.col(text)))
        empty = unsure.filter("_set.n = 0").select(*kept.columns)
        one = unsure.join(heads, (F.col(doc_id) == F.col("_id")) & (F.col("_set.node") == F.col("_node"))).dropDuplicates([doc_id, "_comp"]).select(*kept.columns)
        kept = kept.join(ids, doc_id, "left_anti").unionByName(empty).unionByName(one)
    loose = found.filter("id is null and n > 0")
    if not loose.isEmpty():
        held = loose.filter("component_id is null").select("node", "comp").distinct()
        without = kept.filter(F.col(doc_id).isNull()).withColumn("_set", _sets()(F.col(text)))
        without = without.join(held.select(F.col("node").alias("_node"), F.col("comp").alias("_comp")), F.col("_set.node") == F.col("_node"), "left")
        empty = without.filter("_set.n = 0").select(*kept.columns)
        one = without.filter("_comp is not null").dropDuplicates(["_comp"]).select(*kept.columns)
        kept = kept.filter(F.col(doc_id).isNotNull()).unionByName(empty).unionByName(one)
    return kept.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return join(C.documents(spark, sf_dir))


#: The contract in DuckDB SQL. Pairs come from the shingles that both sides hold;
#: components by walking the links.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""
