"""Derived input tables (Spark side), computed from the driver tables.

Every table here is derived from ``documents`` / ``labels`` at query time,
so its size grows with the data; nothing is stored or made up. The DuckDB
spelling of the same tables is in ``vulnscan.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import NEWLINE_MARKER, PROSE_KEEP_RE
from ..session import by_key, read_table
from .oracle import BRANCHES, EXTRA_MEMBERS, HEADS, METHODLESS, PROBES

CRLF = "\r\n"


def _hex_int(s: Column, n: int) -> Column:
    """Integer value of the first ``n`` hex digits of a hex string."""
    return F.conv(F.substring(s, 1, n), 16, 10).cast("bigint")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def _extra_member() -> Column:
    out = F.lit(None).cast("string")
    for i, (text, _) in enumerate(EXTRA_MEMBERS):
        out = F.when(F.col("doc_id") % len(EXTRA_MEMBERS) == i, text).otherwise(out)
    return out


def code_files_from(docs: DataFrame) -> DataFrame:
    """One C# file per document: CRLF, TAB, both comment kinds, a ``//``
    inside ``/* */``, a URL comment; methods ``Bad`` and ``Good``, and one more member
    of varying form (``EXTRA_MEMBERS``). Every seventh file is a bare block without a
    method, behind a byte order mark."""
    did = F.col("doc_id").cast("string")
    body = F.replace(
        F.regexp_replace("text", PROSE_KEEP_RE, ""), F.lit("\n"), F.lit(";" + CRLF + "\t")
    )
    code = F.concat(
        F.lit("/* "), F.col("source"), F.lit(CRLF + " * // "), F.col("lang"), F.lit(" */" + CRLF),
        F.lit("namespace N" + CRLF + "{" + CRLF),
        F.lit("class C"), did, F.lit(CRLF + "{" + CRLF),
        F.lit("\tpublic C"), did, F.lit("(int k) { this.k = k; }" + CRLF),
        F.lit("\tpublic override void Bad(string a)" + CRLF + "\t{" + CRLF),
        F.lit("\t\tif (a != null) { // http://"), F.col("source"), F.lit(CRLF),
        body,
        F.lit("; }" + CRLF + "\t}" + CRLF),
        F.lit("private int Good() { return "), F.col("n_chars").cast("string"), F.lit("; }" + CRLF),
        _extra_member(), F.lit(CRLF),
        F.lit("}" + CRLF + "}" + CRLF),
    )
    bare = F.concat(F.lit("\ufeff{" + CRLF), body, F.lit(CRLF + "}" + CRLF))
    return docs.select("doc_id", F.when(F.expr(METHODLESS), bare).otherwise(code).alias("code"))


def code_files(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The derived files, as they come from the scan. ``spread`` deals the documents
    over all cores first: only for CPU-heavy steps that shuffle anyway, where the
    input is one Parquet row group (as the small test tables are), which a scan
    cannot split. Corpora have many row groups and do not need it."""
    docs = documents(spark, sf_dir)
    return code_files_from(by_key(docs, "doc_id", text="text") if spread else docs)


def branch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived files with conditional lines of several forms before ``Good``."""
    text = F.lit(None).cast("string")
    for i, (form, _) in enumerate(BRANCHES):
        text = F.when(F.col("doc_id") % len(BRANCHES) == i, form).otherwise(text)
    before = F.lit("private int Good()")
    return code_files(spark, sf_dir).select("doc_id", F.replace("code", before, F.concat(text, before)).alias("code"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled snippet table with planted exact duplicates and NULL CWEs."""
    base = (
        code_files(spark, sf_dir, spread=True)
        .join(labels(spark, sf_dir).select("doc_id", "toxic"), "doc_id")
        .select(
            "doc_id",
            F.col("code").alias("Snippet"),
            F.col("toxic").cast("int").alias("Target"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("CWE-"), (F.lit(70) + F.col("doc_id") % 20).cast("string")))
            .alias("CWE"),
        )
    )
    dups = base.filter(F.col("doc_id") % 10 == 0)
    return base.drop("doc_id").unionAll(dups.drop("doc_id"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores for every labelled document."""
    h = F.md5(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    return labels(spark, sf_dir).select(
        "doc_id",
        (_hex_int(h, 6) / F.lit(16777216.0)).alias("p1"),
        F.col("toxic").cast("int").alias("label"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text token table: newline -> separator token, integer scores."""
    # Partitioned by doc_id before the explode: the text moves, not the token
    # rows, and the per-document windows downstream need no exchange.
    d = by_key(documents(spark, sf_dir), "doc_id", text="text")
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" " + NEWLINE_MARKER + " ")), " ")
    t = d.select("doc_id", F.posexplode_outer(words).alias("pos", "token")).filter(F.col("token") != "")
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string")))
    return t.select("doc_id", "pos", "token", (_hex_int(h, 2) % 4).alias("score"))


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer attention weights of every token position (key) from 2 heads and 2 query
    probes: the input grows with the tokens, not with their pairs."""
    t = tokens(spark, sf_dir).select("doc_id", F.col("pos").alias("k"))
    probes = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(q).alias("q")) for h in range(HEADS) for q in range(PROBES)])
    t = t.select("doc_id", F.explode(probes).alias("p"), "k").select("doc_id", "p.head", "p.q", "k")
    h = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ("doc_id", "head", "q", "k")]))
    return t.select("doc_id", "head", "q", "k", _hex_int(h, 2).alias("w"))
