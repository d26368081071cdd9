"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns, against plain-Python versions of the contracts."""

import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_conftest import collected, edge_rows, prose
from vulnscan.llm import decontamination, jaccard_join, license_scan, packing, pii, quality_classifier, quality_rules, sharding, token_count, url_filter

ROWS = edge_rows()


def expected(fn):
    return sorted(((key, *fn(text)) for key, text in ROWS), key=repr)


def test_token_count(edge, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def count(text):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        return len((text or "").encode()), n, n > 1024

    assert collected(token_count.count_tokens(edge)) == expected(count)
    assert token_count.count_tokens(nothing).count() == 0


def test_packing(edge, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(edge, pool_tokens=5000).collect()
    assert packing.pack(nothing).count() == 0
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in ROWS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    # every id of every document lies in exactly one piece, with its checksum
    ids = defaultdict(list)
    for (key, n), (_, text) in zip([(k, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in ROWS], ROWS, strict=True):
        ids[key, n].append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    assert sum(len(x) for v in ids.values() for x in v) == sum(map(len, want)) == sum(r.length for r in rows)
    for key, found in pieces.items():
        copies = ids[key]
        found = sorted(found, key=lambda r: r.start)
        at = defaultdict(int)
        for r in found:
            at[r.start] += 1
            assert any(zlib.crc32(np.array(c[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for c in copies)
        if len(copies) == 1:
            assert [r.start for r in found] == [0, *np.cumsum([r.length for r in found])[:-1].tolist()]
    for found in sequences.values():
        found = sorted(found, key=lambda r: r.offset)
        total = sum(r.length for r in found)
        assert [r.offset for r in found] == [0, *np.cumsum([r.length for r in found])[:-1].tolist()]
        assert total <= 4096 and total & (total - 1) == 0  # no padding at all
        assert len({r.step_group for r in found}) == 1


def test_jaccard_join(edge, nothing):
    got = collected(jaccard_join.join(edge))
    assert got == sorted(brute.near_duplicates(ROWS), key=repr)
    assert jaccard_join.join(nothing).count() == 0
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns
    want = {k for k, _, c in brute.near_duplicates(ROWS) if k == c}
    assert {r.doc_id for r in kept.collect()} - {None} == want - {None}
    # of the rows without id, the copy of document 7 goes and the one without text stays
    assert kept.filter("doc_id = 13").count() == 1 and [r.text for r in kept.filter("doc_id is null").collect()] == [None]
    assert jaccard_join.keep_one(nothing).count() == 0


def test_keep_one_decides_by_row_where_an_id_repeats(spark):
    a, b, c, d, e = (prose(i, 80) for i in range(20, 25))
    near = a + " more"
    rows = [(1, near), (5, a), (5, b), (6, c), (6, d), (6, d), (6, None), (7, e), (7, e + " more"), (7, ""), (8, e), (8, None), (9, b)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.text) for r in kept if r.doc_id != 7), key=repr)
    assert got == sorted([(1, near), (5, b), (6, c), (6, d), (6, None), (8, None)], key=repr)
    sevens = [r.text for r in kept if r.doc_id == 7]
    assert len(sevens) == 2 and "" in sevens and set(sevens) & {e, e + " more"}


def test_license_scan(edge, nothing):
    got = license_scan.scan(edge)
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert collected(got, *cols) == expected(brute.license_base)
    by = {r.doc_id: r for r in got.collect()}
    assert by[23].labels == "apache-2,gpl-3" and by[23].base_labels == "apache-2"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in by.values())
    assert license_scan.scan(nothing).count() == 0


def test_quality_rules(edge, nothing):
    got = quality_rules.judge(edge)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, *cols) == expected(brute.quality_base)
    assert got.filter("base_failed and kept").count() == 0
    assert quality_rules.judge(nothing).count() == 0


HINDI = "नदी के किनारे एक पुराना पुल है जहाँ सुबह की रोशनी ठंडे पत्थर पर गिरती है और लोग धीरे चलते हैं".split()
THAI = "แม่น้ำ สาย ยาว ไหล ผ่าน เมือง เก่า ใน ตอนเช้า ผู้คน เดิน ช้า ๆ บน สะพาน หิน และ ฟัง เพลง จาก สวน".split()


def test_quality_rules_never_judge_by_another_script(spark):
    import random

    rng = random.Random(5)
    rows = [(i, prose(100 + i, 150), "en") for i in range(60)]
    thai = [(1000 + i, " ".join(rng.choices(THAI, k=150)), "th") for i in range(40)]
    rare = [(2000 + i, " ".join(rng.choices(HINDI, k=150)), ("hi", None)[i % 2]) for i in range(6)]
    rare += [(3000, " ".join(rng.choices("город река мост зима сад письмо музыка бумага окно утро камень свет дорога тихий старый".split(), k=150)), "ru")]
    for table in (rows + rare, thai + rare, rows + rare + thai[:5]):
        judged = quality_rules.judge(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()
        assert all(r.kept for r in judged if r.doc_id >= 1000)
    # a rare language of a common script is judged by that script
    odd = spark.createDataFrame([*rows, (4000, " ".join(f"{c}q{c}z#{i}" for i, c in enumerate("zxqjkvwp" * 20)), "xx")], "doc_id long, text string, lang string")
    assert [(r.base_failed, r.kept) for r in quality_rules.judge(odd).filter("doc_id = 4000").collect()] == [(False, False)]


def test_quality_rules_judge_entropy_at_any_length(spark):
    import random

    rows = [(i, prose(200 + i, (60, 150, 600, 2500)[i % 4]), "en") for i in range(80)]
    rng = random.Random(6)

    def poor(n):  # whole words, few of them; no window of 8 twice
        few = rng.sample(prose(7, 400).split(), 5)
        while True:
            text = rng.choices(few, k=n)
            if quality_rules.repeated(quality_rules.C.WordHash().of([w.encode() for w in text])) * 100 < 30 * n:
                return " ".join(text)

    bad = [(1000, poor(25), "en"), (1001, poor(150), "en"), (1002, poor(1500), "en")]
    clean = [(2000 + n, prose(300 + n, n), "en") for n in (20, 22, 25, 30, 40)]
    judged = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows + bad + clean, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in judged.values())
    assert [k for k, r in judged.items() if not r.kept] == [k for k in judged if 1000 <= k < 2000]
    ids = np.random.default_rng(1).integers(0, 300, 60_000)
    assert abs(quality_rules.window_entropy(ids, 64) - quality_rules.window_entropy(ids[:6000], 64)) < 0.01
    assert quality_rules.window_entropy(ids[:63], 64) is None and quality_rules.window_entropy(np.zeros(100, int), 64) == pytest.approx(0)


def test_scripts():
    texts = {"Hello": "latin", "123 !": "none", "": "none", "Ñandú Üß": "latin", "Привет": "cyrillic", "Γειά": "greek", "שלום": "hebrew", "سلام": "arabic",
             "नदी": "devanagari", "น้ำ": "thai", "河水很长": "han", "川の水は長い": "kana", "강물": "hangul", "tiếng Việt": "latin"}
    assert {t: quality_rules.script_of(t) for t in texts} == texts


def test_pii(edge, nothing):
    got = pii.find(edge)
    base = got.select("doc_id", F.sha2(pii.listed("_base"), 256).alias("digest"), "_all")
    assert sorted(((r.doc_id, r.digest) for r in base.collect()), key=repr) == sorted(((k, brute.pii_row(t)[-1]) for k, t in ROWS), key=repr)
    assert [s.kind for r in base.filter("doc_id = 21").collect() for s in r["_all"]] == ["secret"]
    clean = pii.redact(edge)
    assert clean.columns == edge.columns and clean.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and "a.b+c" not in texts[20] and "[EMAIL]" in texts[20] and "[IP]" in texts[20] and "[CARD]" in texts[20]
    assert texts[21] == 'token = "[SECRET]" and more' and texts[7] == dict(ROWS)[7]
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0


OPENED = {"phone: 555-123-4567 now": "555-123-4567", "Tel 0171 2345678 here": "0171 2345678", "call 555-123-4567 555-987-6543": "555-123-4567|555-987-6543",
          "password: hunter2 ok": "hunter2", 'my Password = "letmein"': "letmein", "api_key=ab12-cd34-ef56-gh78.": "ab12-cd34-ef56-gh78",
          "see 3f2a9c1e-77b0-4d55-9e1f-0a1b2c3d4e5f end": "3f2a9c1e-77b0-4d55-9e1f-0a1b2c3d4e5f", "Authorization: Bearer abc.DEF-9 x": "abc.DEF-9",
          "fax: (030) 123 4567": "(030) 123 4567", "number 12 34 56 78 9 end": "12 34 56 78 9", "monkey: banana or key words": "",
          "in 2024 and 1999, 12 34": "", "+1 555 12": "", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8": "", "abc1234567 x1234567": ""}


def test_pii_lead_words_and_digit_groups_open_candidates(spark):
    docs = spark.createDataFrame(list(enumerate(OPENED)), "doc_id long, text string")
    rows = pii.candidates(pii.base(docs, "text", "doc_id")).select("doc_id", "_text", "_c").collect()
    assert {r["_text"]: "|".join(r["_text"][c.start : c.end] for c in r["_c"]) for r in rows} == OPENED
    lines = ["phone: 555-%03d-%04d" % (100 + i, 2000 + 37 * i) for i in range(30)] + ["Tel 0171 %07d" % (2345678 + 991 * i) for i in range(30)]
    lines += [f"password: hunter{i}" for i in range(30)] + [f"on 2024-01-{10 + i} we met" for i in range(20)] + [f"the ratio was 100 200 {300 + i}" for i in range(30)]
    clean = pii.redact(spark.createDataFrame([(i, f"{prose(i, 5)} {x}") for i, x in enumerate(lines)], "doc_id long, text string")).orderBy("doc_id").collect()
    ends = [r.text.split(" ", 5)[-1] for r in clean]
    assert ends[:90] == ["phone: [LOCAL_PHONE]"] * 30 + ["Tel [LOCAL_PHONE]"] * 30 + ["password: [SECRET]"] * 30
    assert ends[90:] == lines[90:]


def test_pii_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.example.org 10.0.{i % 256}.1" for i in range(3000))
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.order, s.end, s.kind) for s in row["_base"]] == brute.pii_base(text)


def test_pii_has_no_slow_or_recursive_pattern(spark):
    texts = ["a" * 200_000, "1." * 100_000, "1 " * 100_000, "a@" + "b." * 100_000, "+1" + "(" * 100_000, "(" * 100_000, "A_" * 100_000]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(s.start, s.order, s.end, s.kind) for s in r["_base"]] for r in rows] == [brute.pii_base(t) for t in texts]


ITEMS = [(1, None), (2, ""), (3, "one two three"), (4, " ".join(str(dict(ROWS)[7]).split()[10:30])), (4, "cold tail"), (5, "TAIL!"), (6, "..")]


@pytest.mark.parametrize("limit", [decontamination.MAX_BROADCAST_WINDOWS, 0])
def test_decontamination(spark, edge, nothing, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.judge(edge, items, limit=limit)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(got, *cols) == expected(lambda t: brute.contamination(t, ITEMS))
    assert decontamination.judge(nothing, items, limit=limit).count() == 0
    assert decontamination.judge(edge, items.limit(0), limit=limit if limit else -1).filter("contaminated or n_hit > 0").count() == 0
    kept = decontamination.clean(edge, items, limit=limit)
    assert kept.columns == edge.columns
    assert kept.count() == sum(not brute.contamination(t, ITEMS)[-1] for _, t in ROWS)


def test_sharding(edge, nothing):
    rows = sharding.shard(edge, shards=4).collect()
    assert len(rows) == len(ROWS)
    want = sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in ROWS), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == want
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 4
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(nothing).count() == 0


def test_sharding_balances_and_splits_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = [(i, "same text") for i in range(2000)] + [(2000 + i, "x" * (i % 97)) for i in range(2000)] + [(None, "same text")] * 50
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 98


def test_sharding_ranges_stay_short_where_a_third_of_the_rows_is_tiny(spark, monkeypatch):
    """Null texts share one hash and hardly weigh anything beside long ones."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = sharding.keyed(spark.createDataFrame([(i, None if i % 3 == 0 else f"{i} " + "x" * 5000) for i in range(6000)], "doc_id long, text string"))
    n_rows, n_bytes = len(r := rows.collect()), sum(x.size for x in r)
    got = sharding.ranged(rows, n_rows, n_bytes).collect()
    ranges = defaultdict(list)
    for x in got:
        ranges[x["range"]].append((x.h, x.doc_id, x.row))
    # 120 ranges asked for, four keys sampled for each
    assert len(ranges) > 60 and max(map(len, ranges.values())) < 8 * 50
    ordered = [ranges[k] for k in sorted(ranges)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
    heads, stretches = sharding.splitters(rows, n_rows, n_bytes).first()
    assert heads == [s[0] for s in stretches] and sum(map(len, stretches)) == max(ranges)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "https://www.EXAMPLE.com/en/", "http://example.com", "http://example.com?/en/",
            "x://q.net/es/1", "x://net/fr/", "x://network/fr/", "http://a.org/#/en/", "a://b://c/d", "http://spam-farm.example.org/en/1",
            "http://www.example.org/de/7", "http://h/" + "p" * 50_000, "http://h\n.com/en/\n/x", "http://a.org/1", "http://a.org/1"]
    rows = [(i, u, "clash", "clash", "clash", "clash") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, `_slots` string, host string, path string, rule string")
    got = url_filter.judge(df.select("page_id", "url", "host", "path", "rule")).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        host, path, name, verdict = brute.url_parts(u)
        assert (r.host, r.path, r.rule) == (host, path, name), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    by = {r.url: r.verdict for r in got}
    assert by["http://spam-farm.example.org/en/1"] == "block" and by["http://www.example.org/de/7"] == "allow" and by[None] == "allow"
    assert url_filter.judge(df.select("page_id", "url").limit(0)).count() == 0


def test_quality_classifier(spark, edge, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 13)] + [(7, None), (None, 1), (8, 0)], "doc_id long, quality int")
    got = quality_classifier.judge(edge, labels).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert quality_classifier.judge(edge, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality_classifier.judge(nothing, labels).count() == 0
    assert quality_classifier.keep_good(edge, labels).columns == edge.columns


def test_word_vectors_tell_plain_words_apart(spark):
    import random

    rng = random.Random(8)
    makers = [sorted({w for w in prose(seed, 400).split() if len(w) > 3})[:80] for seed in (31, 32)]
    first, second = (sorted(set(a) - set(b)) for a, b in (makers, makers[::-1]))
    # both topics have the same shapes, lengths and shares of distinct words
    rows, labels = [], []
    for i in range(600):
        topic = (first, second)[i % 2]
        rows.append((i, " ".join(rng.choices(topic, k=60))))
        labels += [(i, 1 - i % 2)] if i < 400 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = quality_classifier.unit(quality_classifier.context_table(docs))
    slots = [quality_classifier.word_slot(w.encode()) for w in first[:20] + second[:20]]
    cosine = table[slots] @ table[slots].T
    assert np.median(cosine[:20, 20:]) < 0.3 < np.median(cosine[:20, :20])
    judged = quality_classifier.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).filter("doc_id >= 400").collect()
    assert sum((r.score > 0.5) == (r.doc_id % 2 == 0) for r in judged) >= 0.95 * len(judged)
