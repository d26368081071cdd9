"""A2, A4-A6 against the Python fold on random sequences and edge tables."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from models import SEPARATORS, line_scores, mask_special, rank_lines
from vulnscan.operators import attribution as A

TOK = st.sampled_from(["a", "b", "x"] + list(SEPARATORS))
SEQ = st.lists(st.tuples(TOK, st.integers(min_value=0, max_value=3)), min_size=1, max_size=30)


def _frame(spark, seqs):
    data = [(d, p, t, s) for d, seq in enumerate(seqs) for p, (t, s) in enumerate(seq)]
    return spark.createDataFrame(data, "doc_id bigint, pos bigint, token string, score bigint")


def _spark_lines(spark, seqs, masked):
    t = _frame(spark, seqs)
    if masked:
        t = A.mask_special(t)
    got = {d: [] for d in range(len(seqs))}
    for r in A.line_scores(t).orderBy("doc_id", "line_idx").collect():
        got[r.doc_id].append(r.score)
    return got


def _model(seqs, masked):
    out = {}
    for d, seq in enumerate(seqs):
        toks, sc = [t for t, _ in seq], [s for _, s in seq]
        out[d] = line_scores(toks, mask_special(sc) if masked else sc)
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(SEQ, min_size=1, max_size=40))
def test_line_fold_matches_model(spark, seqs):
    assert _spark_lines(spark, seqs, False) == _model(seqs, False)
    assert _spark_lines(spark, seqs, True) == _model(seqs, True)


def test_line_fold_random_bulk(spark):
    rnd = random.Random(7)
    toks = ["a", "b"] + list(SEPARATORS)
    seqs = [
        [(rnd.choice(toks), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 60))] for _ in range(2000)
    ]
    assert _spark_lines(spark, seqs, True) == _model(seqs, True)


EDGE = [
    [("a", 1), ("Ċ", 0), ("Ċ", 2), ("b", 1)],  # consecutive separators
    [("a", 0), ("Ċ", 3), ("b", 2), ("Ċ", 1)],  # zero-score line dropped
    [("a", 2), ("Ċ", 0), ("b", 5)],  # last token alone on its line: lost
    [("a", 2), ("Ċ", 1)],  # last token a separator
    [("a", 0), ("b", 0), ("Ċ", 0)],  # all zeros
]


def test_line_fold_edges(spark):
    assert _spark_lines(spark, EDGE, False) == _model(EDGE, False) == {0: [1], 1: [3], 2: [2], 3: [3], 4: []}


def test_mask_special(spark):
    seqs = [[("a", 3), ("b", 2), ("c", 1), ("d", 0)], [("a", 0), ("b", 0)], [("a", 5)]]
    t = A.mask_special(_frame(spark, seqs)).orderBy("doc_id", "pos").collect()
    got = {}
    for r in t:
        got.setdefault(r.doc_id, []).append(r.score)
    assert got == {0: [0, 2, 0, 0], 1: [0, 0], 2: [0]}
    t2 = A.mask_special(_frame(spark, seqs), padding=False).orderBy("doc_id", "pos").collect()
    got2 = {}
    for r in t2:
        got2.setdefault(r.doc_id, []).append(r.score)
    assert got2 == {0: [0, 2, 1, 0], 1: [0, 0], 2: [0]}


def test_rank_and_top_ten_ties_are_stable(spark):
    vals = [5, 1, 5, 0, 3, 3, 3, 3, 3, 3, 3, 3, 3, 2]
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "doc_id bigint, line_idx bigint, score bigint")
    top = A.top_lines(A.rank_lines(lines)).first().vul_lines
    assert top == ",".join(str(i) for i in rank_lines(vals)[:10])
    assert top == "0,2,4,5,6,7,8,9,10,11"


def test_split_forms_match_model(spark):
    rnd = random.Random(11)
    toks = ["a", "b"] + list(SEPARATORS)
    seqs = [
        [(rnd.choice(toks), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 80))] for _ in range(300)
    ] + EDGE
    for padding in (True, False):
        t = A.mask_special_split(_frame(spark, seqs), padding=padding)
        got = {d: [] for d in range(len(seqs))}
        for r in A.line_scores_split(t, chunk_rows=4).orderBy("doc_id", "line_idx").collect():
            got[r.doc_id].append(r.score)
        want = {
            d: line_scores([x for x, _ in s], mask_special([y for _, y in s], padding)) for d, s in enumerate(seqs)
        }
        assert got == want


def test_top_lines_split_matches_model(spark):
    rnd = random.Random(5)
    docs = [[rnd.choice([0, 1, 1, 2, 3, 5]) for _ in range(rnd.randint(1, 40))] for _ in range(200)]
    rows = [(d, i, v) for d, vals in enumerate(docs) for i, v in enumerate(vals)]
    lines = spark.createDataFrame(rows, "doc_id bigint, line_idx bigint, score bigint")
    got = {r.doc_id: r.vul_lines for r in A.top_lines_split(lines, chunk_rows=3).collect()}
    want = {d: ",".join(str(i) for i in rank_lines(vals)[:10]) for d, vals in enumerate(docs)}
    assert got == want


def test_array_lines_equal_windows(spark):
    import random

    from vulnscan.functions.constants import NEWLINE_MARKER

    rng = random.Random(3)
    rows = [(k, [(rng.random() < 0.3, float(rng.randrange(4))) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 5, 40, 400, 30, 7, 7, 7])]
    arrays = spark.createDataFrame(rows, "doc_id long, t array<struct<sep:boolean,score:double>>")
    tokens = spark.createDataFrame([(k, i, NEWLINE_MARKER if sep else "x", s) for k, t in rows for i, (sep, s) in enumerate(t)], "doc_id long, pos long, token string, score double")
    want = {r.doc_id: r.vul_lines for r in A.ranked_top_lines(tokens, padding=False).collect()}
    top = F.transform(A.array_top_lines(F.col("t")), lambda x: x["line_idx"].cast("string"))
    got = {r.doc_id: r.v for r in arrays.select("doc_id", F.array_join(top, ",").alias("v")).collect()}
    assert got == {k: want.get(k, "") for k, _ in rows}
    nothing = spark.createDataFrame([([],), (None,)], "t array<struct<sep:boolean,score:double>>")
    assert [r[0] for r in nothing.select(A.array_top_lines(F.col("t"))).collect()] == [None, None]


def _exchanged(df):
    parts = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    return [p for p in parts if "Exchange" in p.split("\n")[0]]


def test_token_scores_leave_token_rows_where_they_are(spark):
    """tokens and their scores lie together by key; no row is exchanged again by position."""
    from vulnscan.session import by_key

    texts = spark.createDataFrame([(1, "a b a"), (2, "c"), (None, "d")], "doc_id long, text string")
    t = by_key(texts, "doc_id", text="text").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    att = by_key(texts, "doc_id", text="text").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "x"))
    att = att.filter("pos < 2").select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") + 5).alias("score"))
    att = att.unionAll(att.filter("doc_id = 2"))
    out = A.token_scores(t, att)
    assert not any("pos" in p for p in _exchanged(out))
    assert sorted((r.doc_id or 0, r.pos, r.token, r.score) for r in out.collect()) == [
        (0, 0, "d", 0), (1, 0, "a", 5), (1, 1, "b", 6), (1, 2, "a", 0), (2, 0, "c", 5), (2, 0, "c", 5)]


def test_split_forms_read_the_tokens_once(spark):
    """the tokens are not exchanged by chunk and not read again for every step."""
    from vulnscan.session import by_key

    texts = spark.createDataFrame([(1, "a b Ċ a Ċ b"), (None, "a Ċ b a")], "doc_id long, text string")
    t = by_key(texts, "doc_id", text="text").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    masked = A.mask_special_split(t.withColumn("score", F.lit(2)), chunk_rows=2)
    assert not any("token" in p for p in _exchanged(masked))
    lines = A.line_scores_split(masked, chunk_rows=2)
    assert not any("token" in p for p in _exchanged(lines))
    assert [tuple(r) for r in lines.orderBy("line_idx").collect()] == [(1, 0, 4), (1, 1, 4)]
