"""Training, the best model, save/load round trip, batch UDF."""

import numpy as np
from pyspark.sql import functions as F

from vulnscan.operators import scoring as C
from vulnscan.plans import jobs as P
from vulnscan.session import scratch_path


def _train_rows(spark):
    rows = [(i, ["override", "null", "x"] if i % 2 else ["private", "return", "y"], i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "row_id int, tokens array<string>, label int")


def test_training_keeps_the_best_model_and_saves_it(spark):
    df = _train_rows(spark)
    model, kept = C.train_classifier(df, df, ["row_id"])
    assert kept.first().f1 == 1.0 and kept.first().alpha == model.alpha == min(C.ALPHAS)  # ties: the smallest
    path = scratch_path(spark, "model")
    C.save_model(model, path)
    a = {r.row_id: r.p1 for r in C.apply_model(model, df, ["row_id"]).collect()}
    b = {r.row_id: r.p1 for r in C.apply_model(C.load_model(spark, path), df, ["row_id"]).collect()}
    assert a == b
    # separable toy data: the classifier learns it
    assert all((p > 0.5) == (i % 2 == 1) for i, p in a.items())


def test_weights_are_smoothed_log_ratios_of_every_token(spark):
    import math

    df = spark.createDataFrame([(1, ["a", "a", "b"], 1), (2, ["b", "c"], 0), (3, [], 0)], "row_id int, tokens array<string>, label int")
    weights, biases = C.train_candidates(df, alphas=(1.0,))
    got = {r.token: r.w[0] for r in weights.collect()}
    want = {t: math.log((c1 + 1) / (3 + 3)) - math.log((c0 + 1) / (2 + 3)) for t, c1, c0 in (("a", 2, 0), ("b", 1, 1), ("c", 0, 1))}
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t]) for t in want)
    assert math.isclose(biases[0], math.log(2 / 3))


def test_batch_udf_equals_linear_scorer(spark):
    df = spark.createDataFrame([(1, ["override", "null", "null"]), (2, []), (3, ["private", "z"])], "id int, toks array<string>")
    score = C.batch_scorer(C.make_fixed_linear_model(), n_features=len(C.FIXED_WEIGHTS))
    got = {r.id: r.p for r in df.select("id", score(C.token_count_features("toks")).alias("p")).collect()}
    w = dict(C.FIXED_WEIGHTS)
    for i, toks in [(1, ["override", "null", "null"]), (2, []), (3, ["private", "z"])]:
        z = sum(w.get(t, 0.0) for t in toks) + C.FIXED_BIAS
        assert np.isclose(got[i], 1 / (1 + np.exp(-z)))


def test_eval_report_keys(spark):
    from vulnscan.plans import jobs as P

    rows = [(f"class C{i} {{ void M() {{ {'override null' if i % 2 else 'return'}; }} }}", i % 2, None) for i in range(60)]
    snippets = spark.createDataFrame(rows, "Snippet string, Target int, CWE string")
    _, rep = P.train_and_eval(snippets)
    assert set(rep.columns) >= {"eval_recall", "eval_precision", "eval_f1", "eval_threshold", "eval_loss"}
    r = rep.first()
    assert 0.0 <= r.eval_f1 <= 1.0 and r.eval_threshold == 0.5
    assert rep.select(F.col("eval_loss") >= 0).first()[0]


def test_sequence_model_gives_p1_and_line_ranks(spark):
    """A model whose scores depend on the place of a token, over files of uneven methods."""
    def make():
        def predict(sequences):
            p1 = [0.9 if "bad" in s else 0.1 for s in sequences]
            return p1, [[float(i % 3) if t != "<s>" else 9.0 for i, t in enumerate(s)] for s in sequences]

        return predict

    code = "class C { int Bad() { return bad; } void Ok() { } long Worse(int a, int b) { bad(); if (a > b) { b = bad; } return 1; } }"
    files = spark.createDataFrame([(i, code) for i in range(40)] + [(99, "{ }")], "doc_id long, code string")
    rows = P.scan_files(files, model=C.sequence_scorer(make, batch_rows=7)).collect()
    assert {(r.name, r.vulnerable, r.p1) for r in rows} == {("Bad", 1, 0.9), ("Ok", 0, 0.1), ("Worse", 1, 0.9)}
    assert len(rows) == 120 and all((r.vul_lines is None) == (r.vulnerable == 0) for r in rows)

    tokens = {r.name: r.t for r in rows_with_tokens(spark, files)}
    for r in rows:
        if r.vulnerable:
            scores = make()([tokens[r.name]])[1][0]
            assert r.vul_lines == line_fold_of(tokens[r.name], scores)


def line_fold_of(tokens, scores, k=10):
    from vulnscan.functions.constants import LINE_SEPARATORS

    scores = [0.0, *scores[1:-1], 0.0]
    lines, content, total = [], 0.0, 0.0
    for i, (t, s) in enumerate(zip(tokens, scores, strict=True)):
        total += s
        if t in LINE_SEPARATORS or i + 1 == len(tokens):
            if content:
                lines.append(total)
            content = total = 0.0
        else:
            content += s
    order = sorted(range(len(lines)), key=lambda i: (-lines[i], i))[:k]
    return ",".join(map(str, order))


def rows_with_tokens(spark, files):
    from vulnscan.functions.text import clean_multi_line
    from vulnscan.operators.features import tokenize_code, with_markers
    from vulnscan.operators.methods import extract_methods

    return extract_methods(files.filter("doc_id = 0")).select("name", with_markers(tokenize_code(clean_multi_line("method"))).alias("t")).collect()


def test_sequence_model_must_score_every_token(spark):
    import pytest

    def make():
        return lambda sequences: ([0.5] * len(sequences), [[0.0]] * len(sequences))

    df = spark.createDataFrame([(["a", "b"],)], "t array<string>")
    with pytest.raises(Exception, match="one score a token"):
        df.select(C.sequence_scorer(make)(F.col("t"))).collect()
