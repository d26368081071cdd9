"""The registered queries and the pipeline on the smallest tables, against plain Python."""

import zlib

import brute
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from vulnscan.llm import base_columns, packing, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(E.queries())
    assert {n.split("_")[0] for n in set(queries.QUERIES) - set(base_columns.QUERIES)} == {f"op{i}" for i in range(1, 14)}
    assert not any(n.startswith("op") for n in base_columns.QUERIES)
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "pii", "packing"]


def test_ids_do_not_depend_on_the_words_remembered():
    """The pipeline's packing remembers fewer words than the operator, with the same ids."""
    texts = [" ".join(f"word{chr(97 + i % 26)}{i % 9} plain, {'xyz'[j % 3]}!" for i in range(j, j + 30)) for j in range(40)]
    few, many = packing.Encoder(cached_words=16), packing.Encoder()
    for at in range(0, len(texts), 4):
        part = pa.array(texts[at : at + 4])
        assert [x.tolist() for x in few.encode(part)] == [x.tolist() for x in many.encode(part)]
    assert len(few.words.places) < len(many.words.places)


def test_stages_equal_their_brute_force_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        path = str(tmp_path / name)
        stages[name](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    judged = quality_classifier.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in judged.filter("predicted = 1").collect()}
    a = step("quality_classifier", docs)
    assert a.columns == columns and {r.doc_id for r in a.collect()} == good

    rows = [(r.doc_id, r.text) for r in a.collect()]
    b = step("jaccard_join", a)
    assert b.columns == columns
    assert {r.doc_id for r in b.collect()} == {k for k, _, c in brute.near_duplicates(rows) if k == c}

    rows = [(r.doc_id, r.text) for r in b.collect()]
    c = step("decontamination", b)
    assert c.columns == columns
    assert {r.doc_id for r in c.collect()} == {k for k, t in rows if not brute.contamination(t, items)[-1]}

    before = {r.doc_id: r.text for r in c.collect()}
    d = step("pii", c)
    after = {r.doc_id: r.text for r in d.collect()}
    assert d.columns == columns and before.keys() == after.keys()
    for key, text in before.items():
        assert not brute.pii_base(after[key])
        if not brute.pii_base(text) and "token" not in text.lower():
            assert after[key] == text
    assert all(r.n_chars == len(r.text) for r in d.collect())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = step("packing", d).collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in after.items()}
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op6_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cols = ", ".join(got.columns)
    want = con.execute(f"SELECT {cols} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
