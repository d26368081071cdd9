"""C1 by epochs against a plain-Python fit; thresholds against every cut; split by cut hashes."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnscan.operators import dataset as X
from vulnscan.operators import fitting as FI
from vulnscan.operators import metrics as G


def _rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        words = [rng.choice(["a", "b", "c", "d", "bad" if y and rng.random() < 0.7 else "e"]) for _ in range(rng.randrange(0, 12))]
        out.append((i, words, y))
    return out


def _plain_fit(train, val, slots, epochs, rate, decay, patience):
    slot = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % slots

    def features(words):
        c = Counter(map(slot, words))
        norm = math.sqrt(sum(v * v for v in c.values())) or 1.0
        return {k: v / norm for k, v in c.items()}

    sets = [[(features(w), y) for _, w, y in part] for part in (train, val)]
    w, b, history, kept, least = {}, 0.0, [], None, (math.inf, 0)
    for epoch in range(epochs + 1):
        z = [[sum(x * w.get(k, 0.0) for k, x in f.items()) + b for f, _ in part] for part in sets]
        loss = [sum(math.log1p(math.exp(a)) - y * a for a, (_, y) in zip(zs, part, strict=True)) / max(1, len(part)) for zs, part in zip(z, sets, strict=True)]
        flags = [(1 / (1 + math.exp(-a)) > 0.5, y) for a, (_, y) in zip(z[1], sets[1], strict=True)]
        tp, wrong = sum(p and y == 1 for p, y in flags), sum(p != (y == 1) for p, y in flags)
        f1 = 2 * tp / (2 * tp + wrong) if tp else 0.0
        history.append((epoch, *loss, f1))
        if kept is None or f1 > history[kept[2]][3]:
            kept = (dict(w), b, epoch)
        if loss[1] < least[0]:
            least = (loss[1], epoch)
        if epoch - least[1] >= patience:
            break
        g, gb, n = Counter(), 0.0, max(1, len(train))
        for a, (f, y) in zip(z[0], sets[0], strict=True):
            e = 1 / (1 + math.exp(-a)) - y
            gb += e
            for k, x in f.items():
                g[k] += e * x
        w = {k: w.get(k, 0.0) - rate * (g[k] / n + decay * w.get(k, 0.0)) for k in {*w, *g}}
        b -= rate * gb / n
    return kept, history


@pytest.mark.parametrize("patience, rate", [(3, 4.0), (2, 40.0)])
def test_fit_equals_plain_python(spark, patience, rate):
    train, val = _rows(1, 300), _rows(2, 80)
    frame = lambda rows: spark.createDataFrame(rows, "row_id long, tokens array<string>, label int").repartition(5)
    settings = dict(slots=64, epochs=12, rate=rate, decay=1e-3, patience=patience)
    model, history = FI.fit_epochs(frame(train), frame(val), **settings)
    kept, want = _plain_fit(train, val, **settings)
    got = [tuple(r) for r in history.orderBy("epoch").collect()]
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1:4] == pytest.approx(b[1:], abs=1e-6) for a, b in zip(got, want, strict=True))
    assert [r[0] for r in got if r[4]] == [kept[2]] == [model.epoch]
    assert model.bias == pytest.approx(kept[1], abs=1e-6)
    assert model.weights == pytest.approx({k: v for k, v in kept[0].items() if v}, abs=1e-6)
    scores = {r.row_id: r.p1 for r in FI.apply_hashed(model, frame(val), ["row_id"]).collect()}
    assert len(scores) == len(val)


def test_fit_without_rows_stays_untrained(spark):
    nothing = spark.createDataFrame([], "row_id long, tokens array<string>, label int")
    model, history = FI.fit_epochs(nothing, nothing, slots=16, epochs=3)
    assert model.weights == {} and model.bias == 0.0 and model.epoch == 0
    odd = spark.createDataFrame([(1, None, 1), (2, [], 0)], "row_id long, tokens array<string>, label int")
    assert [r.p1 for r in FI.apply_hashed(model, odd, ["row_id"]).collect()] == [0.5, 0.5]


def test_threshold_curve_equals_every_cut(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(20) / 20, rng.randrange(2)) for _ in range(300)] + [(None, 1), (float("nan"), 1), (float("nan"), 0), (0.5, None)]
    df = spark.createDataFrame(rows, "p1 double, label int").repartition(4)
    scores = [(p if p is not None and not math.isnan(p) else -math.inf, y == 1, p is not None and not math.isnan(p)) for p, y in rows]
    want = []
    for t in [-math.inf, *sorted({p for p, _, ok in scores if ok})]:
        tp = sum(ok and p > t and y for p, y, ok in scores)
        fp = sum(ok and p > t and not y for p, y, ok in scores)
        fn = sum(y for _, y, _ in scores) - tp
        want.append((t, tp, fp, fn, tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)))
    got = [tuple(r) for r in G.threshold_curve(df).orderBy("threshold").collect()]
    assert got == [pytest.approx(w) for w in want]
    best = G.best_threshold(df).first()
    assert (best.f1, best.threshold) == pytest.approx(max((w[6], w[0]) for w in want))
    assert [tuple(r)[:4] for r in G.threshold_curve(df.limit(0)).collect()] == [(-math.inf, 0, 0, 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1003])
def test_split_by_cut_equals_ranked_split(spark, n):
    df = spark.createDataFrame([(f"text {i}", i % 2) for i in range(n)], "t string, y int").repartition(3)
    for prefix_len in (1, 4):
        a = sorted(tuple(r) for r in X.split_by_cut(df, prefix_len=prefix_len).select("row_id", "t", "split").collect())
        b = sorted(tuple(r) for r in X.split_exact(df).select("row_id", "t", "split").collect())
        assert a == b and len(a) == n


def test_split_by_cut_moves_hashes_only(spark, tmp_path):
    df = spark.createDataFrame([(f"text {i}", i % 2) for i in range(500)], "some_text string, y int")
    df.write.parquet(str(tmp_path / "t"))
    plan = X.split_by_cut(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0]]
    assert exchanges and not any("some_text" in part for part in exchanges)


def test_a_task_unfolds_few_rows_at_a_time(monkeypatch):
    """features are arrays, and an epoch's work space does not grow with the Arrow batch."""
    n, words = 8192, 64
    column = pd.Series([np.arange(words, dtype=np.int32) * 7 + i % 5 for i in range(n)])
    tracemalloc.start()
    made = FI._features(column)
    assert tracemalloc.get_traced_memory()[0] < 24 * n * words  # Python numbers took 68 bytes a pair
    columns = [pa.array([i % 3 == 0 for i in range(n)]), pa.array([i % 2 for i in range(n)]),
               pa.array(made["slot"], pa.list_(pa.int32())), pa.array(made["value"], pa.list_(pa.float64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["held", "y", "slot", "value"])

    class Shared:
        value = np.linspace(-1, 1, 512), 0.25

    def sums():
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        (out,) = FI._epoch(Shared, 0.5)(iter([batch]))
        return tracemalloc.get_traced_memory()[1] - before, dict(zip(*(c.to_pylist() for c in out.columns), strict=True))

    peak, got = sums()
    assert peak < 8 * n * words  # one array over the whole batch
    monkeypatch.setattr(FI, "EPOCH_ROWS", n)
    assert sums()[1] == pytest.approx(got, rel=1e-9, abs=1e-9)
    tracemalloc.stop()
