"""Tokens, vocabulary, ids, padding, mask."""

from pyspark.sql import functions as F

from vulnscan.functions.constants import BLOCK_SIZE, CLS_ID, PAD_ID, SEP_ID, UNK_ID
from vulnscan.operators import features as FT


def test_tokenize_code(spark):
    df = spark.createDataFrame([('if (a != null) {\n x += "s\\"q"; }',)], "c string")
    toks = df.select(FT.tokenize_code("c").alias("t")).first().t
    assert toks == ["if", "(", "a", "!=", "null", ")", "{", "Ċ", "x", "+=", '"s\\"q"', ";", "}"]


def test_vocab_ids_pad_and_mask(spark):
    long = "x" * 5000
    rows = [(1, ["a", "b", "a"]), (2, ["b", "c"] * 400), (3, []), (4, [long])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    vocab = FT.build_vocab(df)
    v = {r.token: r.id for r in vocab.collect()}
    assert v["<s>"] == CLS_ID and v["<pad>"] == PAD_ID and v["</s>"] == SEP_ID and v["<unk>"] == UNK_ID
    assert v["b"] == 4 and v["c"] == 5 and v["a"] == 6 and v[long] == 7  # count desc, then token; no cap
    vocab = vocab.filter("token <> 'a'")  # as of another corpus: 'a' is unknown
    seq = df.select("doc_id", FT.with_markers(FT.truncate_tokens("tokens")).alias("seq"))
    enc = {r.doc_id: r for r in FT.encode_ids(seq, vocab, "doc_id", "seq").collect()}
    assert enc[1].ids == [CLS_ID, UNK_ID, 4, UNK_ID, SEP_ID]
    assert enc[3].ids == [CLS_ID, SEP_ID]
    assert len(enc[2].ids) == BLOCK_SIZE
    padded = FT.encode_ids(seq, vocab, "doc_id", "seq").select(
        "doc_id", FT.pad_ids("ids").alias("p"), FT.attention_mask(FT.pad_ids("ids")).alias("m")
    )
    for r in padded.collect():
        assert len(r.p) == BLOCK_SIZE
        assert sum(r.m) == len(enc[r.doc_id].ids)
    dec = {r.doc_id: r.tokens for r in FT.decode_ids(FT.encode_ids(seq, vocab, "doc_id", "seq"), vocab, "doc_id").collect()}
    assert dec[1] == ["<s>", "<unk>", "b", "<unk>", "</s>"]


def test_vocabulary_ranks_equal_a_global_sort_and_need_no_single_task(spark):
    rows = [(i, [f"t{i % 700}", f"u{i % 40}", ";"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    got = [(r.token, r.cnt) for r in FT.build_vocab(df).filter("id >= 4").orderBy("id").collect()]
    from collections import Counter

    want = Counter(t for _, ts in rows for t in ts)
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))
    plan = FT.build_vocab(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan


def test_long_literals_do_not_recurse(spark):
    escapes, doubled = '"' + "\\u0041" * 1_000_000 + '"', '@"' + '""' * 1_000_000 + '"'
    df = spark.createDataFrame([(1, f"x = {escapes};"), (2, f"x = {doubled};")], "doc_id long, c string")
    toks = {r.doc_id: r.t for r in df.select("doc_id", FT.tokenize_code("c").alias("t")).collect()}
    assert toks == {1: ["x", "=", escapes, ";"], 2: ["x", "=", doubled, ";"]}


def test_preview_markers(spark):
    df = spark.createDataFrame([(["Ġint", "x"],)], "t array<string>")
    assert df.select(FT.preview_tokens("t").alias("p")).first().p == ["_int", "x"]
    assert df.select(F.size("t")).first()[0] == 2


def test_lookup_joins_distinct_tokens(spark):
    """A token meets the vocabulary once a group of sequences; repeated keys
    and entries, null keys, tokens and sequences give what a join of every token gives."""
    rows = [(1, ["a", "b", "a"]), (1, ["c", "a"]), (2, None), (None, ["b"]), (3, ["a", None, "z"]), (4, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "token string, id int")
    enc = FT.encode_ids(df, vocab, "doc_id")
    got = {r.doc_id: (r.tokens, r.ids) for r in enc.collect()}
    assert got == {
        1: (["a", "c", "a", "b", "a"], [4, 6, 4, 5, 4]), 2: ([], []), None: (["b"], [5]), 3: (["a", None, "z"], [4, UNK_ID, UNK_ID]), 4: ([], [])}
    again = vocab.unionAll(vocab.filter("token = 'a'").withColumn("id", F.lit(9)))
    got = {r.doc_id: r.ids for r in FT.encode_ids(df.filter("doc_id = 3"), again, "doc_id").collect()}
    assert got == {3: [4, 9, UNK_ID, UNK_ID]}
    dec = {r.doc_id: r.tokens for r in FT.decode_ids(enc, vocab, "doc_id").collect()}
    assert dec == {1: ["a", "c", "a", "b", "a"], 2: [], None: ["b"], 3: ["a", "<unk>", "<unk>"], 4: []}
    plan = enc._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Aggregate [_g" in plan
