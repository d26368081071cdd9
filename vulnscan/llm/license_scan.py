"""Operator 4 [native]: licence scan through a positional rare-token index.

The index maps a licence word to (template, offset) postings. Which words of a
template are its index words is decided by their inverse document frequency
over the whole corpus: the ``ANCHORS`` rarest ones (the counts of at most all
template words come back to the driver). A file's words are looked up in that
index; postings of one template meet at a relative position (file position minus
offset), and a start position is kept if the mandatory key phrase stands at its
place there, word by word. Its score is the share of the template's IDF weight
that agrees at the start.

Base: a template that is nothing but its key phrase counts every place. Since an
occurrence holds the index words at their offsets, none can be missed.

Defined cases: null and empty texts have no words and no labels; very long texts
are scanned whole; several templates may hit one place (labels are distinct);
an empty table gives no rows; other columns are ignored by ``scan`` (pass them in
``keep``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ANCHORS = 2
#: Share of IDF weight from which a template beyond the base phrases is a label.
MIN_SCORE = 0.6

#: Base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Templates of the method: label, mandatory key phrase, whole template.
TEMPLATES = (
    ("gpl-3", "gnu general public license", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license", "gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)


def _find(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def catalogue() -> list[dict]:
    """Base phrases and templates alike: label, words, key phrase and its offset."""
    made = [{"label": la, "words": ph.split(), "key": ph.split(), "at": 0, "base": True} for la, ph in BASE]
    for label, key, text in TEMPLATES:
        made.append({"label": label, "words": text.split(), "key": key.split(), "at": _find(text.split(), key.split()), "base": False})
    return made


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(C.fold(text), C.ALNUM_SEPARATORS), "")


def idf(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word, over all documents. At most
    one row for each licence word comes to the driver."""
    import math

    some = F.array_intersect(words_of(F.col(text)), F.array(*[F.lit(w) for w in vocabulary]))
    counted = docs.select(F.explode(some).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counted.collect()}
    return {w: 1.0 / (1.0 + math.log1p(df.get(w, 0))) for w in vocabulary}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of ``keep``, n_words, n_base, first_word, last_word, base_labels,
    labels, score and hits (array of label, start, score, base)."""
    templates = catalogue()
    weight = idf(docs, sorted({w for t in templates for w in t["words"]}), text)
    for t in templates:  # index words: the rarest of the key phrase, so that no key phrase is missed
        order = sorted(range(len(t["key"])), key=lambda k: (-weight[t["key"][k]], k))
        t["anchors"] = [(t["key"][k], t["at"] + k) for k in order[:ANCHORS]]
        t["idf"] = sum(weight[w] for w in t["words"])
    index = sorted({w for t in templates for w, _ in t["anchors"]})

    rows = docs.select(doc_id, *keep, words_of(F.col(text)).alias("_w"))
    places = F.filter(F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1)).otherwise(F.array().cast("array<int>")),
                      lambda i: F.get(F.col("_w"), i).isin(index))
    # postings: (word, place) of index words only; the other words are looked at by position
    rows = rows.select("*", places.alias("_p"))
    rows = rows.select("*", F.transform("_p", lambda i: F.struct(F.get(F.col("_w"), i).alias("w"), i.alias("i"))).alias("_postings"))
    rows = rows.select("*", _hits(templates, weight).alias("hits"))
    return _summary(rows, doc_id, keep)


def _hits(templates: list[dict], weight: dict[str, float]) -> Column:
    found = [_template_hits(t, weight) for t in templates]
    none = F.array().cast("array<struct<label:string,start:int,score:double,base:boolean>>")
    return F.when(F.size("_postings") > 0, F.concat(*found)).otherwise(none)


def _template_hits(t: dict, weight: dict[str, float]) -> Column:
    """Starts at which every index word stands at its offset, then the key phrase."""
    w = F.col("_w")
    (rare, offset), *others = t["anchors"]
    starts = F.transform(F.filter("_postings", lambda p: p["w"] == rare), lambda p: p["i"] - offset)
    at = lambda s, k: F.get(w, F.greatest(s + k, F.lit(-1)))  # noqa: E731  null outside the text
    agree = lambda s, pairs: reduce(lambda a, b: a & b, [F.coalesce((s + k >= 0) & (at(s, k) == word), F.lit(False)) for word, k in pairs])
    if others:
        starts = F.filter(starts, lambda s: agree(s, others))
    key = [(word, t["at"] + k) for k, word in enumerate(t["key"])]
    starts = F.filter(starts, lambda s: agree(s, key))

    def score(s):
        parts = [F.when((s + k >= 0) & (at(s, k) == word), F.lit(weight[word])).otherwise(0.0) for k, word in enumerate(t["words"])]
        return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts) / F.lit(t["idf"]))

    return F.transform(starts, lambda s: F.struct(
        F.lit(t["label"]).alias("label"), (s + t["at"]).cast("int").alias("start"),
        (F.lit(1.0) if t["base"] else score(s)).alias("score"), F.lit(t["base"]).alias("base")))


def _summary(rows: DataFrame, doc_id: str, keep) -> DataFrame:
    rows = rows.withColumn("_b", F.filter("hits", lambda h: h["base"]))
    starts = F.transform("_b", lambda h: h["start"])
    known = F.filter("hits", lambda h: h["base"] | (h["score"] >= MIN_SCORE))
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    best = F.aggregate("hits", F.lit(0.0), lambda a, h: F.greatest(a, h["score"]))
    return rows.select(
        doc_id, *keep, F.size("_w").cast("long").alias("n_words"), F.size("_b").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined("_b").alias("base_labels"), joined(known).alias("labels"), F.round(best, 6).alias("score"), "hits")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir)).drop("hits")
