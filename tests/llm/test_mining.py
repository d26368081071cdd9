"""Hard negatives, periodic runs and SimHash classes against plain-Python versions."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_conftest import collected, edge_rows
from vulnscan.llm import hard_negatives, periodic_runs, simhash

ROWS = edge_rows()


# -- hard negatives ----------------------------------------------------------------------


def mined(rows):
    """[(id, vector, label)] -> the contract's rows, by all pairs."""
    kept = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * x) for x in vector]
        kept.append((key, v, (label + 1) % 10 if key is not None and key % 7 == 0 else label))
    last = lambda k: (k is None, k or 0)
    out = []
    for i, (key, a, label) in enumerate(kept):
        if key is None or key % 50:
            continue
        scores = [(sum(p * q for p, q in zip(a, x, strict=False)), k, y) for j, (k, x, y) in enumerate(kept) if j != i]
        scores.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, pid, _ in [s for s in scores if s[2] == label][:5]:
            inside = [s for s in scores if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(key, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def vector_rows(seed, n, dims=6, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in c], rng.randrange(10)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, row string, score string").repartition(3)


def mine(df, **kw):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return collected(hard_negatives.mine(df, moved, F.col("vec_id") % 50 == 0, **kw))


@pytest.mark.parametrize("block, slice_", [(2048, 2048), (37, 3)])
def test_hard_negatives_equal_all_pairs(spark, block, slice_):
    rows = vector_rows(1, 400)
    rows += [(i, rows[0][1], 3) for i in range(400, 460)]  # a hot vector, ties by id
    assert mine(frame(spark, rows), block=block, slice_=slice_) == mined(rows)


def test_hard_negatives_edges(spark):
    rows = vector_rows(2, 120)
    rows += [(1000, None, 1), (1050, [0.1, None, 0.3, 0.0, 0.0, 0.0], 2), (1100, [float("nan")] * 6, 2), (1150, [float("inf")] + [0.0] * 5, 2),
             (1200, [1.0] * 6, None), (None, [1.0] * 6, 2), (1250, [], 3), (1300, [2.0, 1.0], 4), (50, rows[50][1], rows[50][2]), (100, [0.5] * 6, 1)]
    assert mine(frame(spark, rows)) == mined(rows)
    assert mine(frame(spark, rows[:1])) == []
    assert mine(frame(spark, rows).limit(0)) == []
    assert mine(frame(spark, [(i + 1, v, y) for i, v, y in vector_rows(3, 40)])) == []  # no anchors


def test_hard_negatives_beyond_doubles(spark):
    rows = [(i, [x * 2.0**17 for x in v], y) for i, v, y in vector_rows(4, 150)]
    got = mine(frame(spark, rows))
    assert got == mined(rows) and max(r[4] for r in got) > 2**50


def test_bounds_spare_products():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (5, 16))
    v = np.floor(centres[rng.integers(0, 5, 600)] + rng.normal(0, 4, (600, 16))).astype(np.int64)
    import pyarrow as pa

    table = pa.table({"id": np.arange(600), "row": np.arange(600), "label": np.arange(600) % 3, "v": list(v)})
    anchors, block = hard_negatives.Rows(table.slice(0, 100)), hard_negatives.Rows(table)
    asked = spared = 0
    for a, scores in hard_negatives.scored(anchors, block):
        product = block.v @ anchors.v[a]
        assert (scores.low <= product).all() and (product <= scores.high).all()
        scores.best(np.arange(600), 5)
        asked += 600
        spared += int((scores.low < scores.high).sum())
    assert spared > asked / 2


# -- periodic runs -----------------------------------------------------------------------


def runs_of(w, least=6, repeats=4):
    """Every maximal stretch of each period, the smallest period of each."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items() if n >= max(least, repeats * q))


def planted_words(key, text):
    w = brute.space_words(text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def reported(key, text):
    w = planted_words(key, text)
    found = runs_of(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (key, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(kept))


def test_run_kernel_equals_all_periods():
    rng = random.Random(12)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 5)):
            w = [bytes([97 + rng.randrange(rng.randint(1, 4))]) for _ in range(rng.randint(0, 50))]
            if len(w) > 4 and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, 6)
                w = [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < len(w) else w[i] for i in range(len(w))]
            texts.append(w)
        for least, repeats in ((6, 4), (2, 2)):
            got = periodic_runs.runs(texts, least, repeats)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [runs_of(w, least, repeats) for w in texts]


def test_periodic_runs(spark, edge, nothing):
    repeated = [(100 + i, t) for i, t in enumerate(["ha " * 9, "a b " * 2 + "a b c " * 9 + "d", "one two three four " * 5, "x y " * 3, "no no no no no", "a\tb\n" * 40 + "é é é é é é é"])]
    some = [(i, f"w{i % 7} " * (i % 5) + " ".join(f"t{(i * j) % 11}" for j in range(i % 60))) for i in range(200, 400)]
    rows = [(k, t) for k, t in ROWS if len((t or "").split()) < 500] + repeated + some
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collected(periodic_runs.report(periodic_runs.find_runs(periodic_runs.planted(docs))))
    assert got == sorted((reported(k, t) for k, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    assert periodic_runs.report(periodic_runs.find_runs(periodic_runs.planted(edge))).count() == len(ROWS)
    assert periodic_runs.report(periodic_runs.find_runs(periodic_runs.planted(nothing))).count() == 0


def test_long_periodic_texts():
    for words, run in (([b"a"] * 30_000, (0, 30_000, 1)), ([b"%d" % (i % 997) for i in range(50_000)], (0, 50_000, 997))):
        assert [tuple(r) for r in periodic_runs.runs([words])[0].tolist()] == [run]


# -- SimHash -----------------------------------------------------------------------------


def fingerprint(text):
    w = brute.space_words(brute.fold(text))
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, edge, nothing):
    prints = [fingerprint(t) for _, t in ROWS]
    root = classes(prints)
    want = []
    for (key, _), fp, r in zip(ROWS, prints, root, strict=True):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if root[j] == r and ROWS[j][0] is not None]
        want.append((key, f"{fp:016x}", min(ids, default=None)))
    assert collected(simhash.near_duplicates(edge)) == sorted(want, key=repr)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("limits", [{}, {"group": 20}, {"group": 0}])
def test_simhash_links_equal_all_pairs(spark, limits):
    rng = random.Random(13)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(100)}
    for c in centres:  # chains and balls of near fingerprints
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), **limits).collect()
    place = {p: i for i, p in enumerate(signed)}
    assert all((prints[place[e.a]] ^ prints[place[e.b]]).bit_count() <= 64 for e in edges)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        root[find(place[e.a])] = find(place[e.b])
    want = classes(prints)
    pairs = {}
    for i in range(len(prints)):
        assert pairs.setdefault(want[i], find(i)) == find(i)
    assert len(set(pairs.values())) == len(pairs)


def test_simhash_forest_is_no_larger_than_its_members():
    base = 0x0123456789ABCDEF
    near = np.array([base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], np.uint64)  # all within 4 bits of each other
    a, b = simhash.forest(np.zeros(len(near), np.int64), near.view(np.int64), 4)
    assert len(a) == len(near) - 1 and len(set(b.tolist())) == 1
