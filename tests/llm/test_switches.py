"""Rules that must not change by size, and secrets of any length."""

import pytest
from pyspark.sql import functions as F

from llm_conftest import prose
from vulnscan.llm import decontamination, pii, quality_rules

FILL = [(i, f"{prose(i, 40)} api_key={'%032x' % (i * 7919 + 12345)} {prose(i + 500, 10)}") for i in range(60)]


@pytest.mark.parametrize("before, secret", [
    ("api_key=", "Ab3" * 34_000), ("api_key=", "k9Z" * 167), ("Authorization: Bearer ", "eyJ0" * 175), ('"password": "', "correct horse battery"), ("password = '", "two words"),
])
def test_a_secret_goes_whole(spark, before, secret):
    text = f"first words {before}{secret}" + (before[-1] if before[-1] in "\"'" else "") + " last words"
    docs = spark.createDataFrame([*FILL, (1000, text)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}[1000]
    assert out.startswith("first words ") and out.endswith(" last words")
    assert len(out) < 80 and not any(part in out for part in (secret[:8], secret[-8:], "horse", "words'"))


@pytest.mark.parametrize("limit", [10_000, 0])
def test_items_without_id_hit_but_are_not_counted(spark, limit):
    passage = prose(1, 30)
    items = spark.createDataFrame([(None, passage), ("a", passage), ("b", prose(2, 30))], "item_id string, text string")
    docs = spark.createDataFrame([(1, passage), (2, prose(3, 40)), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.judge(docs, items, limit=limit).collect()}
    assert got == {1: (30, 1, True), 2: (0, 0, False), 3: (0, 0, False)}


def test_one_more_document_changes_no_verdict(spark):
    """29 or 30 documents of a language: the verdicts of the others stay."""
    rows = [(i, prose(i, 150), "en") for i in range(200)]
    last = None
    for n in (29, 30):
        table = spark.createDataFrame(rows + [(1000 + i, prose(3000 + i, 150).replace("e", "ee"), "xx") for i in range(n)], "doc_id long, text string, lang string")
        kept = {r.doc_id: r.kept for r in quality_rules.judge(table).select("doc_id", "kept").collect()}
        same = {k: v for k, v in kept.items() if k < 1029}
        assert last is None or last == same
        last = same
