"""Query registry: one Spark callable and (where SQL can say it) one DuckDB
oracle per operator of the inventory. Keys are the query names of SURVEY §2.

Each Spark callable takes ``(spark, sf_dir)``, reads the driver tables and
returns a DataFrame; output columns are aliased to the same names and types
as the oracle SQL. Arrays are exposed as joined strings, doubles rounded to 6
digits where summation order could matter.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import FIXED_BIAS
from ..operators import attribution as A
from ..operators import dataset as X
from ..operators import features as FT
from ..operators import fitting as FI
from ..operators import methods as M
from ..operators import metrics as G
from ..operators import scoring as C
from ..session import cut_lineage, scratch_path, stored
from . import fixtures as fx
from . import oracle as O
from . import jobs as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

US = "\x1f"  # separator for arrays exposed as strings


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


CF = [O.CODE_FILES]
SN = [O.CODE_FILES, O.SNIPPETS]


def _sql(ctes: list[str], body: str) -> str:
    return O.with_ctes(*ctes, body=body) if ctes else body


# ---------------------------------------------------------------------------
# Text cleaning
# ---------------------------------------------------------------------------


@register("strip_comments", _sql(CF, f"SELECT doc_id, {O.strip_comments('code')} AS out FROM code_files"))
def q_strip_comments(spark, sf):
    return fx.code_files(spark, sf).select("doc_id", T.strip_comments("code").alias("out"))


@register("drop_cr_tab", _sql(CF, f"SELECT doc_id, {O.drop_cr_tab('code')} AS out FROM code_files"))
def q_drop_cr_tab(spark, sf):
    return fx.code_files(spark, sf).select("doc_id", T.drop_cr_tab("code").alias("out"))


_NB = O.nonblank_lines(O.drop_cr_tab(O.strip_comments("code")))


@register(
    "nonblank_lines",
    _sql(CF, f"SELECT doc_id, CAST(len({_NB}) AS BIGINT) AS n_lines, array_to_string({_NB}, chr(31)) AS out FROM code_files"),
)
def q_nonblank_lines(spark, sf):
    lines = T.nonblank_lines(T.drop_cr_tab(T.strip_comments("code")))
    return fx.code_files(spark, sf).select(
        "doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(lines, US).alias("out")
    )


@register("clean_single_line", _sql(CF, f"SELECT doc_id, {O.clean_single_line('code')} AS out FROM code_files"))
def q_clean_single_line(spark, sf):
    return fx.code_files(spark, sf).select("doc_id", T.clean_single_line("code").alias("out"))


@register("clean_multi_line", _sql(CF, f"SELECT doc_id, {O.clean_multi_line('code')} AS out FROM code_files"))
def q_clean_multi_line(spark, sf):
    return fx.code_files(spark, sf).select("doc_id", T.clean_multi_line("code").alias("out"))


@register(
    "add_line_delimiters",
    _sql(CF, f"SELECT doc_id, {O.add_line_delimiters(O.clean_single_line('code'))} AS out FROM code_files"),
)
def q_add_line_delimiters(spark, sf):
    return fx.code_files(spark, sf).select(
        "doc_id", T.add_line_delimiters(T.clean_single_line("code")).alias("out")
    )


_NORM = (
    f"replace(replace(token, {O.q(O.MARKERS[0])}, ''), {O.q(O.MARKERS[1])}, {O.q(chr(0x10A))})"
)


# the markers of a subword tokenizer, before a third of the tokens and behind another
_MARKED = f"""marked AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN {O.q(O.MARKERS[0])} || token
  WHEN 1 THEN token || {O.q(O.MARKERS[1])} ELSE token END AS token FROM tokens)"""


@register(
    "normalise_tokens",
    _sql([O.TOKENS, _MARKED], f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_NORM} AS token FROM marked"),
)
def q_normalise_tokens(spark, sf):
    marked = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(O.MARKERS[0]), "token")).otherwise(
        F.when(F.col("pos") % 3 == 1, F.concat("token", F.lit(O.MARKERS[1]))).otherwise(F.col("token")))
    t = fx.tokens(spark, sf).withColumn("token", marked)
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.normalise_token(F.col("token")).alias("token"))


@register(
    "token_lines",
    _sql(
        [O.TOKENS],
        f"""SELECT doc_id, CAST(len(string_split(j, {O.q(chr(0x10A))})) AS BIGINT) AS n_lines,
       array_to_string(string_split(j, {O.q(chr(0x10A))}), chr(10)) AS lines
FROM (SELECT doc_id, string_agg(token, '' ORDER BY pos) AS j FROM tokens GROUP BY doc_id) t""",
    ),
)
def q_token_lines(spark, sf):
    t = fx.tokens(spark, sf)
    toks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    g = t.groupBy("doc_id").agg(toks.alias("toks"))
    lines = T.token_lines("toks")
    return g.select(
        "doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(lines, "\n").alias("lines")
    )


# ---------------------------------------------------------------------------
# Method extraction (M1-M5)
# ---------------------------------------------------------------------------

_MT = CF + O.method_ctes()


@register(
    "extract_methods",
    _sql(_MT, "SELECT doc_id, method_idx, name, start_pos, end_pos, method FROM mt_methods"),
)
def q_extract_methods(spark, sf):
    return M.extract_methods(fx.code_files(spark, sf))


@register(
    "outermost_methods",
    _sql(
        _MT,
        f"""SELECT k AS doc_id, CAST(seg AS BIGINT) AS start_seg, CAST(cand_end AS BIGINT) AS end_seg,
       {O.method_name('header')} AS name, kept FROM mt_kept WHERE cand""",
    ),
)
def q_outermost_methods(spark, sf):
    o = M.outermost_methods(fx.code_files(spark, sf))
    return o.select(
        "doc_id", F.col("start_seg").cast("bigint").alias("start_seg"),
        F.col("end_seg").cast("bigint").alias("end_seg"), "name", "kept",
    )


@register(
    "brace_pairs",
    _sql(
        _MT,
        """SELECT k AS doc_id, CAST(level AS BIGINT) AS level, CAST(off + length(text) - 1 AS BIGINT) AS open_pos,
       CAST(partner_stop - 1 AS BIGINT) AS close_pos FROM mt_pair WHERE partner IS NOT NULL""",
    ),
)
def q_brace_pairs(spark, sf):
    b = M.brace_pairs(fx.code_files(spark, sf))
    return b.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("level", "open_pos", "close_pos")]
    )


@register(
    "methods_per_file",
    # what the template holds, not what the rule finds
    f"SELECT doc_id, CAST(CASE WHEN {O.METHODLESS} THEN 0 WHEN doc_id % {len(O.EXTRA_MEMBERS)} > 0 THEN 3 ELSE 2 END AS BIGINT) AS n_methods FROM documents",
)
def q_methods_per_file(spark, sf):
    cf = fx.code_files(spark, sf)
    return M.methods_per_file(cf, M.extract_methods(cf))


@register(
    "active_methods",
    O.with_ctes(*CF, O.BRANCH_FILES, *O.branch_ctes("branch_files"), *O.method_ctes("br_code"), recursive=True,
                body="SELECT doc_id, method_idx, name, start_pos, end_pos, method FROM mt_methods"),
)
def q_active_methods(spark, sf):
    """M1 with one branch of each ``#if`` (Q4), by a table of symbols."""
    return M.extract_methods(fx.branch_files(spark, sf), symbols=O.SYMBOLS)


# ---------------------------------------------------------------------------
# Dataset (P1, P6, X1-X5, S4, E2)
# ---------------------------------------------------------------------------

_DS = SN + O.split_ctes()


@register("snippet_project", _sql(SN, "SELECT Snippet, Target, CWE FROM snippets"))
def q_snippet_project(spark, sf):
    return X.project_snippets(fx.snippets(spark, sf))


@register("cwe_as_string", _sql(SN, "SELECT Snippet, Target, coalesce(CWE, 'nan') AS CWE FROM snippets"))
def q_cwe_as_string(spark, sf):
    return X.cwe_as_string(fx.snippets(spark, sf))


@register(
    "duplicate_rows",
    _sql(
        SN,
        """SELECT Snippet, Target, CWE, CAST(count(*) - 1 AS BIGINT) AS n_extra FROM snippets
GROUP BY Snippet, Target, CWE HAVING count(*) > 1""",
    ),
)
def q_duplicate_rows(spark, sf):
    return X.duplicate_rows(fx.snippets(spark, sf))


@register("drop_duplicates", _sql(SN, "SELECT DISTINCT Snippet, Target, CWE FROM snippets"))
def q_drop_duplicates(spark, sf):
    return X.drop_duplicates(fx.snippets(spark, sf))


@register("drop_duplicates_in_place", _sql(SN, "SELECT DISTINCT Snippet, Target, CWE FROM snippets"))
def q_drop_duplicates_in_place(spark, sf):
    return X.drop_duplicates_in_place(fx.snippets(spark, sf))


@register("split_exact", _sql(_DS, "SELECT row_id, rnk, split FROM dataset"))
def q_split_exact(spark, sf):
    return X.prepare_dataset(fx.snippets(spark, sf)).select("row_id", "rnk", "split")


_HV = O.hex_int(O.row_hash(["Snippet", "Target", "CWE"]), 8) + " % 10000"


@register(
    "split_hash",
    _sql(
        SN,
        f"""SELECT {O.row_hash(['Snippet', 'Target', 'CWE'])} AS row_id,
       CASE WHEN {_HV} < 7000 THEN 'train' WHEN {_HV} < 8500 THEN 'test' ELSE 'val' END AS split
FROM (SELECT DISTINCT Snippet, Target, CWE FROM snippets) u""",
    ),
)
def q_split_hash(spark, sf):
    u = X.drop_duplicates(X.project_snippets(fx.snippets(spark, sf)))
    return X.split_hash(u).select("row_id", "split")


@register(
    "shuffle_order",
    _sql(
        _DS,
        f"""SELECT row_id, CAST(row_number() OVER (ORDER BY md5(concat('{O.SEED}', chr(31), row_id))) - 1 AS BIGINT) AS perm_idx
FROM dataset WHERE split = 'train'""",
    ),
)
def q_shuffle_order(spark, sf):
    ds = X.prepare_dataset(fx.snippets(spark, sf))
    return X.shuffle_order(X.select_split(ds, "train").select("row_id")).select("row_id", "perm_idx")


@register("split_select", _sql(_DS, "SELECT row_id, rnk, Target, CWE FROM dataset WHERE split = 'test'"))
def q_split_select(spark, sf):
    ds = X.prepare_dataset(fx.snippets(spark, sf))
    return X.select_split(ds, "test").select("row_id", "rnk", "Target", "CWE")


@register("split_by_cut", _sql(_DS, "SELECT row_id, split, Snippet, Target, CWE FROM dataset"))
def q_split_by_cut(spark, sf):
    """X3 and E2 without ranks: no exchange of rows after the deduplication."""
    return X.prepare_dataset(fx.snippets(spark, sf), rank=False)


@register("split_in_place", _sql(_DS, "SELECT row_id, split, Snippet, Target, CWE FROM dataset"))
def q_split_in_place(spark, sf):
    """E2 with both steps in place: hashes, places and counts are exchanged, no text."""
    return X.prepare_dataset(fx.snippets(spark, sf), rank=False, in_place=True)


@register("prepare_dataset", _sql(_DS, "SELECT row_id, rnk, split, Snippet, Target, CWE FROM dataset"))
def q_prepare_dataset(spark, sf):
    return X.prepare_dataset(fx.snippets(spark, sf))


# ---------------------------------------------------------------------------
# Features (F1-F9, P2)
# ---------------------------------------------------------------------------

_TOK = O.tokenize_code(O.clean_multi_line("code"))
_TOK_CTE = f"ft_tok AS (SELECT doc_id, {_TOK} AS toks FROM code_files)"
_TRUNC = f"list_slice(toks, 1, {O.BLOCK - 2})"
_SEQ = O.with_markers(_TRUNC)  # the 512 block of F7, F9 and P2
_WHOLE = O.with_markers("toks")


def _code_tokens(spark, sf, spread: bool = False) -> DataFrame:
    return fx.code_files(spark, sf, spread).select("doc_id", FT.tokenize_code(T.clean_multi_line("code")).alias("toks"))


@register(
    "tokenize_code",
    _sql(CF + [_TOK_CTE], "SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, chr(31)) AS tokens FROM ft_tok"),
)
def q_tokenize_code(spark, sf):
    t = _code_tokens(spark, sf)
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", US).alias("tokens"))


@register(
    "truncate_tokens",
    _sql(CF + [_TOK_CTE], f"SELECT doc_id, CAST(len({_TRUNC}) AS BIGINT) AS n_tokens, array_to_string({_TRUNC}, chr(31)) AS tokens FROM ft_tok"),
)
def q_truncate_tokens(spark, sf):
    t = _code_tokens(spark, sf).select("doc_id", FT.truncate_tokens("toks").alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", US).alias("tokens"))


@register(
    "with_markers",
    _sql(CF + [_TOK_CTE], f"SELECT doc_id, CAST(len({_WHOLE}) AS BIGINT) AS n_tokens, array_to_string({_WHOLE}, chr(31)) AS tokens FROM ft_tok"),
)
def q_with_markers(spark, sf):
    t = _code_tokens(spark, sf).select("doc_id", FT.with_markers("toks").alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", US).alias("tokens"))


def vocab_ctes(src_cte: str) -> list[str]:
    """vocab(token, id, cnt) from src_cte(toks)."""
    return [
        f"""vc_cnt AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM {src_cte}) t GROUP BY token)""",
        f"""vocab AS (SELECT * FROM (VALUES ('<s>', 0, 0), ('<pad>', 1, 0), ('</s>', 2, 0), ('<unk>', 3, 0)) r(token, id, cnt)
 UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token ASC) - 1 + 4 AS INTEGER) AS id, cnt FROM vc_cnt)""",
    ]


_VOCAB_CF = CF + [_TOK_CTE] + vocab_ctes("ft_tok")


@register("build_vocab", _sql(_VOCAB_CF, "SELECT token, CAST(id AS INTEGER) AS id, CAST(cnt AS BIGINT) AS cnt FROM vocab"))
def q_build_vocab(spark, sf):
    return FT.build_vocab(_code_tokens(spark, sf, spread=True), "toks")


def _enc_ctes(seq: str) -> list[str]:
    return _VOCAB_CF + [
        f"en_seq AS (SELECT doc_id, {seq} AS seq FROM ft_tok)",
        "en_pos AS (SELECT doc_id, unnest(seq) AS token, unnest(range(0, len(seq))) AS pos FROM en_seq)",
        f"en_ids AS (SELECT doc_id, list(coalesce(v.id, {O.UNK}) ORDER BY pos) AS ids FROM en_pos LEFT JOIN vocab v USING (token) GROUP BY doc_id)",
    ]


_ENC_CTES, _BLOCK_CTES = _enc_ctes(_WHOLE), _enc_ctes(_SEQ)


def _encoded(spark, sf, block: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ids of the whole sequences, or of their first block, and the vocabulary."""
    # The tokens feed both the vocabulary and the encoding: written once to
    # the scratch folder instead of running the tokenizer twice.
    t = stored(_code_tokens(spark, sf, spread=True), "code-tokens")
    vocab = FT.build_vocab(t, "toks")
    toks = FT.truncate_tokens("toks") if block else F.col("toks")
    seq = t.select("doc_id", FT.with_markers(toks).alias("seq"))
    return FT.encode_ids(seq, vocab, "doc_id", "seq"), vocab


def _ids_str(c: str = "ids"):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ")


@register(
    "encode_ids",
    _sql(_ENC_CTES, "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids FROM en_ids"),
)
def q_encode_ids(spark, sf):
    enc, _ = _encoded(spark, sf)
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _ids_str().alias("ids"))


@register(
    "decode_ids",
    _sql(
        _ENC_CTES
        + [
            "de_pos AS (SELECT doc_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM en_ids)",
        ],
        """SELECT doc_id, string_agg(coalesce(v.token, '<unk>'), chr(31) ORDER BY pos) AS tokens
FROM de_pos LEFT JOIN vocab v USING (id) GROUP BY doc_id""",
    ),
)
def q_decode_ids(spark, sf):
    enc, vocab = _encoded(spark, sf)
    dec = FT.decode_ids(enc.select("doc_id", "ids"), vocab, "doc_id")
    return dec.select("doc_id", F.array_join("tokens", US).alias("tokens"))


_PAD = f"list_concat(ids, list_transform(range(0, greatest(0, {O.BLOCK} - len(ids))), lambda x: {O.PAD}))"


@register(
    "pad_ids",
    _sql(_BLOCK_CTES, f"SELECT doc_id, CAST(len({_PAD}) AS BIGINT) AS n_ids, array_to_string({_PAD}, ' ') AS ids FROM en_ids"),
)
def q_pad_ids(spark, sf):
    enc, _ = _encoded(spark, sf, block=True)
    p = enc.select("doc_id", FT.pad_ids("ids").alias("ids"))
    return p.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _ids_str().alias("ids"))


@register(
    "attention_mask",
    _sql(
        _ENC_CTES,
        f"""SELECT doc_id, CAST(len(list_filter(p, lambda x: x <> {O.PAD})) AS BIGINT) AS n_attend,
       array_to_string(list_transform(p, lambda x: CASE WHEN x <> {O.PAD} THEN '1' ELSE '0' END), '') AS mask
FROM (SELECT doc_id, {_PAD} AS p FROM en_ids) t""",
    ),
)
def q_attention_mask(spark, sf):
    enc, _ = _encoded(spark, sf)
    m = enc.select("doc_id", FT.attention_mask(FT.pad_ids("ids")).alias("m"))
    return m.select(
        "doc_id",
        F.size(F.filter("m", lambda x: x)).cast("bigint").alias("n_attend"),
        F.array_join(F.transform("m", lambda x: F.when(x, "1").otherwise("0")), "").alias("mask"),
    )


_EX_CTES = _DS + [
    f"ex_tok AS (SELECT row_id, rnk, split, Target, CWE, {O.tokenize_code(O.clean_multi_line('Snippet'))} AS toks FROM dataset)",
    "ex_train AS (SELECT toks FROM ex_tok WHERE split = 'train')",
] + vocab_ctes("ex_train") + [
    f"ex_seq AS (SELECT row_id, rnk, split, Target, CWE, {_SEQ} AS seq FROM ex_tok)",
    "ex_pos AS (SELECT row_id, unnest(seq) AS token, unnest(range(0, len(seq))) AS pos FROM ex_seq)",
    f"ex_ids AS (SELECT row_id, list(coalesce(v.id, {O.UNK}) ORDER BY pos) AS ids FROM ex_pos LEFT JOIN vocab v USING (token) GROUP BY row_id)",
    f"ex_all AS (SELECT s.row_id, s.rnk, s.split, s.Target AS label, s.CWE AS cwe, s.seq, list_concat(i.ids, list_transform(range(0, greatest(0, {O.BLOCK} - len(i.ids))), lambda x: {O.PAD})) AS input_ids FROM ex_seq s JOIN ex_ids i USING (row_id))",
]


def _examples(spark, sf, first: int | None = None) -> DataFrame:
    """The examples of all rows, or of the first ``first`` rows of the train split."""
    ds = cut_lineage(X.prepare_dataset(fx.snippets(spark, sf)))
    train_toks = X.select_split(ds, "train").select(FT.tokenize_code(T.clean_multi_line("Snippet")).alias("toks"))
    vocab = FT.build_vocab(train_toks, "toks")
    if first is not None:
        ds = X.select_split(ds, "train").orderBy("rnk").limit(first)
    return FT.build_examples(ds, vocab, "row_id", carry=("rnk", "split"))


@register(
    "build_examples",
    _sql(
        _EX_CTES,
        """SELECT row_id, label, cwe, CAST(len(seq) AS BIGINT) AS n_tokens, array_to_string(input_ids, ' ') AS input_ids FROM ex_all""",
    ),
)
def q_build_examples(spark, sf):
    ex = _examples(spark, sf)
    return ex.select(
        "row_id", "label", "cwe", F.size("input_tokens").cast("bigint").alias("n_tokens"),
        _ids_str("input_ids").alias("input_ids"),
    )


@register(
    "preview_examples",
    _sql(
        _EX_CTES,
        f"""SELECT rnk, label, array_to_string(list_transform(seq, lambda x: replace(x, {O.q(O.MARKERS[0])}, '_')), ' ') AS input_tokens,
       array_to_string(input_ids, ' ') AS input_ids FROM ex_all WHERE split = 'train' ORDER BY rnk LIMIT 3""",
    ),
)
def q_preview_examples(spark, sf):
    return _examples(spark, sf, first=3).select(
        "rnk", "label", F.array_join(FT.preview_tokens("input_tokens"), " ").alias("input_tokens"),
        _ids_str("input_ids").alias("input_ids"),
    )


# ---------------------------------------------------------------------------
# Scoring (C3-C7, P3)
# ---------------------------------------------------------------------------

_SC_CTES = CF + [O.WEIGHTS] + O.score_texts_ctes("code_files", ["doc_id"], "code")


def _scored_files(spark, sf) -> DataFrame:
    return P.score_texts(fx.code_files(spark, sf, spread=True), ["doc_id"], "code")


@register(
    "linear_logits",
    _sql(_SC_CTES, "SELECT doc_id, round(logit0, 6) AS logit0, round(logit1, 6) AS logit1 FROM st_scored"),
)
def q_linear_logits(spark, sf):
    s = _scored_files(spark, sf)
    return s.select("doc_id", F.round("logit0", 6).alias("logit0"), F.round("logit1", 6).alias("logit1"))


@register(
    "softmax_prob",
    _sql(_SC_CTES, f"SELECT doc_id, round(1.0 - p1, 6) AS p0, round(p1, 6) AS p1 FROM st_scored"),
)
def q_softmax_prob(spark, sf):
    s = _scored_files(spark, sf)
    return s.select("doc_id", F.round(1.0 - F.col("p1"), 6).alias("p0"), F.round("p1", 6).alias("p1"))


_LOSS_CTES = _SC_CTES + [
    f"ls AS (SELECT s.doc_id, CAST(l.toxic AS INTEGER) AS label, {O.row_log_loss('s.logit0', 's.logit1', 'l.toxic')} AS loss FROM st_scored s JOIN labels l ON s.doc_id = l.doc_id)"
]


def _losses(spark, sf) -> DataFrame:
    s = _scored_files(spark, sf).join(fx.labels(spark, sf).select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
    return s.select("doc_id", "label", C.row_log_loss(F.col("logit0"), F.col("logit1"), F.col("label")).alias("loss"))


@register("row_log_loss", _sql(_LOSS_CTES, "SELECT doc_id, label, round(loss, 6) AS loss FROM ls"))
def q_row_log_loss(spark, sf):
    return _losses(spark, sf).select("doc_id", "label", F.round("loss", 6).alias("loss"))


@register("eval_loss", _sql(_LOSS_CTES, "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(loss), 6) AS eval_loss FROM ls"))
def q_eval_loss(spark, sf):
    return _losses(spark, sf).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.sum("loss"), 6).alias("eval_loss")
    )


_NB_CTES = _DS + [
    f"ex_tok AS (SELECT row_id, split, Target, {O.tokenize_code(O.clean_multi_line('Snippet'))} AS toks FROM dataset)",
    """nb_cnt AS (SELECT token, sum(CASE WHEN Target = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN Target = 1 THEN 0 ELSE 1 END) AS c0
 FROM (SELECT Target, unnest(toks) AS token FROM ex_tok WHERE split = 'train') t GROUP BY token)""",
    "nb_tot AS (SELECT sum(c0) AS n0, sum(c1) AS n1, count(*) AS v FROM nb_cnt)",
    "nb_doc AS (SELECT sum(CASE WHEN Target = 1 THEN 1 ELSE 0 END) AS d1, count(*) AS d FROM ex_tok WHERE split = 'train')",
    "nb_grid AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE)" for a in C.ALPHAS) + ") g(alpha))",
    """nb_w AS (SELECT alpha, token, ln((c1 + alpha) / (n1 + alpha * v)) - ln((c0 + alpha) / (n0 + alpha * v)) AS w
 FROM nb_cnt, nb_tot, nb_grid)""",
    """nb_z AS (SELECT row_id, alpha, sum(w) AS z FROM (SELECT row_id, unnest(toks) AS token FROM ex_tok WHERE split = 'val') t
 JOIN nb_w USING (token) GROUP BY row_id, alpha)""",
    """nb_val AS (SELECT e.row_id, e.Target AS label, g.alpha, 0.0::DOUBLE AS logit0, ln((d1 + 1) / (d - d1 + 1)) + coalesce(z, 0) AS logit1
 FROM (SELECT row_id, Target FROM ex_tok WHERE split = 'val') e CROSS JOIN nb_grid g CROSS JOIN nb_doc
 LEFT JOIN nb_z z ON z.row_id = e.row_id AND z.alpha = g.alpha)""",
    f"""nb_p AS (SELECT *, {O.softmax_p1('logit0', 'logit1')} AS p1, {O.threshold_flag(O.softmax_p1('logit0', 'logit1'))} AS pred,
   {O.row_log_loss('logit0', 'logit1', 'label')} AS loss FROM nb_val)""",
    f"""nb_best AS (SELECT alpha, {O.div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
   SELECT alpha, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
     sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn FROM nb_p GROUP BY alpha) c
 ORDER BY f1 DESC, alpha ASC LIMIT 1)""",
    "nb_kept AS (SELECT p.* FROM nb_p p JOIN nb_best b ON p.alpha = b.alpha)",
]


@register("best_model", _sql(_NB_CTES, "SELECT alpha, round(f1, 6) AS f1 FROM nb_best"))
def q_best_model(spark, sf):
    _, kept = P.train_best(P.labelled_tokens(fx.snippets(spark, sf)))
    return kept.select("alpha", F.round("f1", 6).alias("f1"))


FIT = dict(slots=4096, epochs=6, rate=4.0, decay=1e-4, patience=2)


def _fit_ctes() -> list[str]:
    """ft_hist and ft_pred: the fit written out epoch by epoch."""
    e, rate, decay = FIT["epochs"], FIT["rate"], FIT["decay"]
    ctes = [
        f"ex_tok AS (SELECT row_id, split, CASE WHEN Target = 1 THEN 1 ELSE 0 END AS y, {O.tokenize_code(O.clean_multi_line('Snippet'))} AS toks FROM dataset)",
        f"""ft_cnt AS (SELECT row_id, {O.hex_int('md5(token)', 8)} % {FIT['slots']} AS slot, CAST(count(*) AS DOUBLE) AS c
 FROM (SELECT row_id, unnest(toks) AS token FROM ex_tok) t GROUP BY ALL)""",
        """ft_x AS MATERIALIZED (SELECT row_id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY row_id)) AS x FROM ft_cnt
 UNION ALL SELECT row_id, -1, 1.0 FROM ex_tok)""",
        "ft_y AS MATERIALIZED (SELECT row_id, split, y FROM ex_tok WHERE split <> 'test')",
        "ft_n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM ft_y WHERE split = 'train')",
        "ft_w0 AS MATERIALIZED (SELECT DISTINCT slot, 0.0::DOUBLE AS w FROM ft_x)",
    ]
    for i in range(e + 1):
        ctes.append(f"""ft_p{i} AS MATERIALIZED (SELECT y.row_id, y.split, y.y, sum(x.x * w.w) AS z FROM ft_y y JOIN ft_x x USING (row_id) JOIN ft_w{i} w USING (slot) GROUP BY ALL)""")
        ctes.append(f"""ft_w{i + 1} AS MATERIALIZED (SELECT w.slot, w.w - {rate} * (coalesce(g.g, 0) / (SELECT n FROM ft_n) + CASE WHEN w.slot >= 0 THEN {decay} ELSE 0 END * w.w) AS w
 FROM ft_w{i} w LEFT JOIN (SELECT x.slot, sum((1 / (1 + exp(-p.z)) - p.y) * x.x) AS g FROM ft_p{i} p JOIN ft_x x USING (row_id) WHERE p.split = 'train' GROUP BY x.slot) g USING (slot))""")
    ctes.append("ft_all AS (" + " UNION ALL ".join(f"SELECT {i} AS epoch, * FROM ft_p{i}" for i in range(e + 1)) + ")")
    flag = "1 / (1 + exp(-z)) > 0.5"
    ctes += [
        f"""ft_m AS (SELECT epoch, avg(ln(1 + exp(z)) - y * z) FILTER (split = 'train') AS train_loss, avg(ln(1 + exp(z)) - y * z) FILTER (split = 'val') AS val_loss,
   count(*) FILTER (split = 'val' AND y = 1 AND {flag}) AS tp, count(*) FILTER (split = 'val' AND (y = 1) <> ({flag})) AS wrong FROM ft_all GROUP BY epoch)""",
        "ft_run AS (SELECT *, min(val_loss) OVER (ORDER BY epoch) AS least FROM ft_m)",
        "ft_age AS (SELECT *, epoch - max(CASE WHEN val_loss = least THEN epoch END) OVER (ORDER BY epoch) AS age FROM ft_run)",
        f"""ft_hist AS (SELECT epoch, train_loss, val_loss, {O.div('2 * tp', '2 * tp + wrong')} AS val_f1 FROM ft_age
 WHERE epoch <= coalesce((SELECT min(epoch) FROM ft_age WHERE age >= {FIT['patience']}), {e}))""",
        "ft_best AS (SELECT epoch FROM ft_hist ORDER BY val_f1 DESC, epoch LIMIT 1)",
        "ft_pred AS (SELECT row_id, y, z, 1 / (1 + exp(-z)) AS p1 FROM ft_all WHERE split = 'val' AND epoch = (SELECT epoch FROM ft_best))",
    ]
    return ctes


_FT_CTES = _DS + _fit_ctes()


@register("fit_history", _sql(_FT_CTES, """SELECT CAST(epoch AS INTEGER) AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
   round(val_f1, 6) AS val_f1, epoch = (SELECT epoch FROM ft_best) AS best FROM ft_hist"""))
def q_fit_history(spark, sf):
    """Losses and F1 of every epoch of the iterative fit, the kept one marked."""
    _, history = P.fit_best(P.labelled_tokens(fx.snippets(spark, sf)), **FIT)
    return history.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_f1")], "best")


@register("fit_predict", _sql(_FT_CTES, f"SELECT row_id, CAST(y AS INTEGER) AS label, round(p1, 6) AS p1, {O.threshold_flag('p1')} AS pred FROM ft_pred"))
def q_fit_predict(spark, sf):
    rows = P.labelled_tokens(fx.snippets(spark, sf))
    model, _ = P.fit_best(rows, **FIT)
    val = FI.apply_hashed(model, X.select_split(rows, "val"), ["row_id", "label"])
    return val.select("row_id", F.when(F.col("label") == 1, 1).otherwise(0).alias("label"), F.round("p1", 6).alias("p1"), C.threshold_flag(F.col("p1")).alias("pred"))


_TC_CTES = [
    O.PREDS,
    "tc_s AS (SELECT p1 AS threshold, count(*) AS n, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos FROM tied GROUP BY p1)",
    """tc_u AS (SELECT threshold, sum(n) OVER (ORDER BY threshold) AS n_upto, sum(pos) OVER (ORDER BY threshold) AS pos_upto FROM tc_s
 UNION ALL SELECT '-inf'::DOUBLE, 0, 0)""",
    """tc_c AS (SELECT threshold, CAST((SELECT sum(pos) FROM tc_s) - pos_upto AS BIGINT) AS tp,
   CAST((SELECT sum(n) FROM tc_s) - n_upto - (SELECT sum(pos) FROM tc_s) + pos_upto AS BIGINT) AS fp, CAST(pos_upto AS BIGINT) AS fn FROM tc_u)""",
    f"tc AS (SELECT *, {O.div('tp', 'tp + fp')} AS precision, {O.div('tp', 'tp + fn')} AS recall, {O.div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM tc_c)",
]
# scores in 64ths, so that there are ties
_TC_CTES.insert(1, "tied AS (SELECT floor(p1 * 64) / 64 AS p1, label FROM preds)")


def _tied(spark, sf) -> DataFrame:
    return fx.preds(spark, sf).select((F.floor(F.col("p1") * 64) / 64).alias("p1"), "label")


@register("threshold_curve", _sql(_TC_CTES, "SELECT threshold, tp, fp, fn, precision, recall, f1 FROM tc"))
def q_threshold_curve(spark, sf):
    """Precision, recall and F1 of every threshold."""
    return G.threshold_curve(_tied(spark, sf))


@register("best_threshold", _sql(_TC_CTES, "SELECT threshold, tp, fp, fn, precision, recall, f1 FROM tc ORDER BY f1 DESC, threshold DESC LIMIT 1"))
def q_best_threshold(spark, sf):
    return G.best_threshold(_tied(spark, sf))


@register("threshold_flag", _sql([O.PREDS], f"SELECT doc_id, {O.threshold_flag('p1')} AS pred FROM preds"))
def q_threshold_flag(spark, sf):
    return fx.preds(spark, sf).select("doc_id", C.threshold_flag(F.col("p1")).alias("pred"))


# ---------------------------------------------------------------------------
# Line attribution
# ---------------------------------------------------------------------------

_ATT_SUM = "att_sum AS (SELECT doc_id, k AS pos, CAST(sum(w) AS BIGINT) AS score FROM attention GROUP BY doc_id, k)"


@register("token_attention", _sql([O.TOKENS, O.ATTENTION, _ATT_SUM], "SELECT doc_id, CAST(pos AS BIGINT) AS pos, score FROM att_sum"))
def q_token_attention(spark, sf):
    a = A.token_attention(fx.attention(spark, sf))
    return a.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "score")


_TOKS_B = "tokens_b AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, CAST(score AS BIGINT) AS score FROM tokens)"
_LA = [O.TOKENS, _TOKS_B] + O.attribution_ctes("tokens_b", ["doc_id"], padding=True)


def _tokens_b(spark, sf) -> DataFrame:
    t = fx.tokens(spark, sf)
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token", F.col("score").cast("bigint").alias("score"))


@register("mask_special", _sql(_LA, "SELECT doc_id, pos, CAST(score AS BIGINT) AS score FROM la_mask"))
def q_mask_special(spark, sf):
    return A.mask_special(_tokens_b(spark, sf)).select("doc_id", "pos", "score")


@register(
    "token_scores",
    _sql(
        [O.TOKENS, O.ATTENTION, _ATT_SUM, _TOKS_B],
        """SELECT t.doc_id, t.pos, t.token, CAST(coalesce(a.score, 0) AS BIGINT) AS score
FROM tokens_b t LEFT JOIN att_sum a ON t.doc_id = a.doc_id AND t.pos = a.pos""",
    ),
)
def q_token_scores(spark, sf):
    att = A.token_attention(fx.attention(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))
    return A.token_scores(_tokens_b(spark, sf), att)


@register("line_scores", _sql(_LA, "SELECT doc_id, line_idx, CAST(score AS BIGINT) AS score FROM la_lines"))
def q_line_scores(spark, sf):
    t = A.mask_special(_tokens_b(spark, sf))
    return A.line_scores(t).select("doc_id", "line_idx", F.col("score").cast("bigint").alias("score"))


# Far below the longest documents (thousands of tokens), so that they span many chunks.
CHUNK_ROWS, CHUNK_LINES = 256, 16


@register("line_scores_split", _sql(_LA, "SELECT doc_id, line_idx, CAST(score AS BIGINT) AS score FROM la_lines"))
def q_line_scores_split(spark, sf):
    """A2 + A4 in the split form (no window or join keyed by the document
    alone), for token tables where one document can hold a large share."""
    t = A.mask_special_split(_tokens_b(spark, sf), chunk_rows=CHUNK_ROWS)
    return A.line_scores_split(t, chunk_rows=CHUNK_ROWS).select("doc_id", "line_idx", F.col("score").cast("bigint").alias("score"))


@register("top_lines_split", _sql(_LA, "SELECT doc_id, vul_lines FROM la_top"))
def q_top_lines_split(spark, sf):
    """A2-A6 in the split forms (no window or join keyed by the document alone
    over all of its tokens or lines)."""
    t = A.mask_special_split(_tokens_b(spark, sf), chunk_rows=CHUNK_ROWS)
    return A.top_lines_split(A.line_scores_split(t, chunk_rows=CHUNK_ROWS), chunk_rows=CHUNK_LINES)


@register("rank_lines_split", _sql(_LA, "SELECT doc_id, line_idx, CAST(score AS BIGINT) AS score, rnk FROM la_rank"))
def q_rank_lines_split(spark, sf):
    """A5 without a window over all lines of a document."""
    t = A.mask_special_split(_tokens_b(spark, sf), chunk_rows=CHUNK_ROWS)
    r = A.rank_lines_split(A.line_scores_split(t, chunk_rows=CHUNK_ROWS))
    return r.select("doc_id", "line_idx", F.col("score").cast("bigint").alias("score"), "rnk")


@register("rank_lines", _sql(_LA, "SELECT doc_id, line_idx, CAST(score AS BIGINT) AS score, rnk FROM la_rank"))
def q_rank_lines(spark, sf):
    t = A.mask_special(_tokens_b(spark, sf))
    r = A.rank_lines(A.line_scores(t))
    return r.select("doc_id", "line_idx", F.col("score").cast("bigint").alias("score"), "rnk")


@register("top_lines", _sql(_LA, "SELECT doc_id, vul_lines FROM la_top"))
def q_top_lines(spark, sf):
    return A.ranked_top_lines(_tokens_b(spark, sf))


@register(
    "flagged_top_lines",
    _sql(
        [O.PREDS, O.TOKENS,
         f"tokens_b AS (SELECT t.doc_id, CAST(t.pos AS BIGINT) AS pos, t.token, CAST(t.score AS BIGINT) AS score FROM tokens t JOIN preds p ON t.doc_id = p.doc_id WHERE {O.threshold_flag('p.p1')} = 1)"]
        + O.attribution_ctes("tokens_b", ["doc_id"], padding=True),
        f"""SELECT p.doc_id, {O.threshold_flag('p.p1')} AS vulnerable,
       CASE WHEN {O.threshold_flag('p.p1')} = 1 THEN coalesce(t.vul_lines, '') END AS vul_lines
FROM preds p LEFT JOIN la_top t ON p.doc_id = t.doc_id""",
    ),
)
def q_flagged_top_lines(spark, sf):
    pr = fx.preds(spark, sf).select("doc_id", C.threshold_flag(F.col("p1")).alias("vulnerable"))
    flagged = pr.filter(F.col("vulnerable") == 1).select("doc_id")
    # Gate before ranking: only tokens of flagged documents are ranked.
    toks = _tokens_b(spark, sf).join(flagged, "doc_id", "left_semi")
    top = A.ranked_top_lines(toks)
    return pr.join(top, "doc_id", "left").select(
        "doc_id", "vulnerable",
        F.when(F.col("vulnerable") == 1, F.coalesce("vul_lines", F.lit(""))).alias("vul_lines"),
    )


@register(
    "linear_token_scores",
    _sql(
        CF + [O.WEIGHTS, _TOK_CTE],
        """SELECT t.doc_id, t.pos, t.token, greatest(coalesce(w.w, 0.0), 0.0) AS score
FROM (SELECT doc_id, unnest(toks) AS token, CAST(unnest(range(0, len(toks))) AS BIGINT) AS pos FROM ft_tok) t
LEFT JOIN weights w ON t.token = w.token""",
    ),
)
def q_linear_token_scores(spark, sf):
    t = _code_tokens(spark, sf).select("doc_id", F.posexplode_outer("toks").alias("pos", "token")).filter(
        F.col("pos").isNotNull()
    )
    t = t.withColumn("pos", F.col("pos").cast("bigint"))
    return A.linear_token_scores(t, C.fixed_weights(spark)).select("doc_id", "pos", "token", "score")


# ---------------------------------------------------------------------------
# Metrics (G1-G10)
# ---------------------------------------------------------------------------

_PL = [O.PREDS, f"pl AS (SELECT doc_id, label, {O.threshold_flag('p1')} AS pred FROM preds)"]
_CNT = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"
_CONF = f"""SELECT {_CNT('label <> 1 AND pred <> 1')} AS tn, {_CNT('label <> 1 AND pred = 1')} AS fp,
       {_CNT('label = 1 AND pred <> 1')} AS fn, {_CNT('label = 1 AND pred = 1')} AS tp FROM pl"""


def _pl(spark, sf) -> DataFrame:
    return fx.preds(spark, sf).select("doc_id", "label", C.threshold_flag(F.col("p1")).alias("pred"))


@register("confusion_counts", _sql(_PL, _CONF))
def q_confusion_counts(spark, sf):
    return G.confusion_counts(_pl(spark, sf))


@register(
    "precision_recall_f1",
    _sql(
        _PL,
        f"""SELECT tn, fp, fn, tp, {O.div('tp', 'tp + fp')} AS precision, {O.div('tp', 'tp + fn')} AS recall,
       {O.div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM ({_CONF}) c""",
    ),
)
def q_precision_recall_f1(spark, sf):
    return G.precision_recall_f1(_pl(spark, sf))


def _split_scored_ctes(split: str) -> list[str]:
    return _DS + [O.WEIGHTS, f"sp AS (SELECT * FROM dataset WHERE split = '{split}')"] + O.score_texts_ctes(
        "sp", ["row_id", "Target"], "Snippet"
    ) + [
        f"sp_loss AS (SELECT row_id, Target AS label, pred, {O.row_log_loss('logit0', 'logit1', 'Target')} AS loss FROM st_scored)"
    ]


@register("eval_report", _sql(_split_scored_ctes("val"), O.report_select("sp_loss", "eval", False)))
def q_eval_report(spark, sf):
    return P.eval_report(fx.snippets(spark, sf))


_TEST_REPORT_SQL_BODY = O.report_select("sp_loss", "test", True)


@register("test_report", _sql(_split_scored_ctes("test"), _TEST_REPORT_SQL_BODY))
def q_test_report(spark, sf):
    return P.test_report(fx.snippets(spark, sf))


def _long_sql() -> str:
    keys = sorted(["test_recall", "test_precision", "test_f1", "test_threshold", "test_loss", "TP", "FP", "TN", "FN"])
    unions = " UNION ALL ".join(f"SELECT '{k}' AS key, round(CAST({k} AS DOUBLE), 4) AS value FROM rep" for k in keys)
    return _sql(_split_scored_ctes("test") + [f"rep AS ({_TEST_REPORT_SQL_BODY})"], unions)


@register("report_long", _long_sql())
def q_report_long(spark, sf):
    return G.report_long(P.test_report(fx.snippets(spark, sf)))


@register(
    "quality_gate",
    _sql(_split_scored_ctes("test") + [f"rep AS ({_TEST_REPORT_SQL_BODY})"], f"SELECT test_f1, test_f1 > {O.QUALITY} AS passed FROM rep"),
)
def q_quality_gate(spark, sf):
    return G.quality_gate(P.test_report(fx.snippets(spark, sf)))


@register(
    "join_preds_labels",
    _sql(
        [O.PREDS],
        f"""SELECT p.doc_id, p.p1, {O.threshold_flag('p.p1')} AS pred, CAST(l.toxic AS INTEGER) AS label, CAST(l.quality AS INTEGER) AS quality
FROM preds p JOIN labels l ON p.doc_id = l.doc_id""",
    ),
)
def q_join_preds_labels(spark, sf):
    pr = fx.preds(spark, sf).select("doc_id", "p1", C.threshold_flag(F.col("p1")).alias("pred"))
    lb = fx.labels(spark, sf).select(
        "doc_id", F.col("toxic").cast("int").alias("label"), F.col("quality").cast("int").alias("quality")
    )
    return G.join_preds_labels(pr, lb)


# ---------------------------------------------------------------------------
# End-to-end (E1, E2, E4, E5) and result views
# ---------------------------------------------------------------------------

_SCAN_CTES = CF + [O.WEIGHTS] + O.method_ctes() + [
    f"sc_seq AS (SELECT doc_id, method_idx, {O.with_markers(O.tokenize_code(O.clean_multi_line('method')))} AS seq FROM mt_methods)",
    "sc_tok AS (SELECT doc_id, method_idx, unnest(seq) AS token, CAST(unnest(range(0, len(seq))) AS BIGINT) AS pos FROM sc_seq)",
    "sc_w AS (SELECT t.doc_id, t.method_idx, t.pos, t.token, coalesce(w.w, 0.0) AS w FROM sc_tok t LEFT JOIN weights w ON t.token = w.token)",
    f"sc_p AS (SELECT doc_id, method_idx, {O.softmax_p1('0.0', f'(sum(w) + ({FIXED_BIAS})::DOUBLE)')} AS p1_raw FROM sc_w GROUP BY doc_id, method_idx)",
    f"sc_flag AS (SELECT w.doc_id, w.method_idx, w.pos, w.token, greatest(w.w, 0.0) AS score FROM sc_w w JOIN sc_p p ON w.doc_id = p.doc_id AND w.method_idx = p.method_idx WHERE {O.threshold_flag('p.p1_raw')} = 1)",
] + O.attribution_ctes("sc_flag", ["doc_id", "method_idx"], padding=False) + [
    f"""scan AS (SELECT m.doc_id, m.method_idx, m.name, m.method, round(p.p1_raw, 6) AS p1, {O.threshold_flag('p.p1_raw')} AS vulnerable,
   CASE WHEN {O.threshold_flag('p.p1_raw')} = 1 THEN coalesce(t.vul_lines, '') END AS vul_lines
 FROM mt_methods m JOIN sc_p p ON m.doc_id = p.doc_id AND m.method_idx = p.method_idx
 LEFT JOIN la_top t ON m.doc_id = t.doc_id AND m.method_idx = t.method_idx)"""
]


def _scan(spark, sf, **kw) -> DataFrame:
    return P.scan_files(fx.code_files(spark, sf), **kw)


@register("scan_files", _sql(_SCAN_CTES, "SELECT doc_id, method_idx, name, method, p1, vulnerable, vul_lines FROM scan"))
def q_scan_files(spark, sf):
    return _scan(spark, sf)


@register("scan_model", _sql(_SCAN_CTES, "SELECT doc_id, method_idx, name, method, p1, vulnerable, vul_lines FROM scan"))
def q_scan_model(spark, sf):
    """C2 -> A1 -> E1: a numpy model gives the probability and the token scores."""
    return _scan(spark, sf, model=C.sequence_scorer(C.make_numpy_sequence_model()))


_CLEAN_LINES = O.clean_multi_line("m.method")


@register(
    "scan_lines",
    _sql(_SCAN_CTES + [
        f"""sl AS (SELECT doc_id, method_idx, g, total, row_number() OVER (PARTITION BY doc_id, method_idx ORDER BY total DESC, g ASC) AS rnk
 FROM la_grp WHERE content <> 0)"""],
        f"""SELECT s.doc_id, s.method_idx, CAST(s.rnk AS BIGINT) AS rank, CAST(s.g + 1 AS BIGINT) AS line_no,
   string_split({_CLEAN_LINES}, chr(10))[CAST(s.g + 1 AS BIGINT)] AS line, s.total AS score
FROM sl s JOIN mt_methods m ON m.doc_id = s.doc_id AND m.method_idx = s.method_idx WHERE s.rnk <= {O.TOP_LINES}"""),
)
def q_scan_lines(spark, sf):
    return P.scan_lines(fx.code_files(spark, sf))


@register(
    "vulnerable_rows",
    _sql(_SCAN_CTES, "SELECT doc_id, method_idx, name, p1, vul_lines FROM scan WHERE vulnerable = 1"),
)
def q_vulnerable_rows(spark, sf):
    return P.vulnerable_rows(_scan(spark, sf)).select("doc_id", "method_idx", "name", "p1", "vul_lines")


@register(
    "file_verdict",
    _sql(
        _SCAN_CTES,
        """SELECT c.doc_id, CAST(coalesce(v.v, 0) AS INTEGER) AS vulnerable FROM code_files c
LEFT JOIN (SELECT doc_id, max(vulnerable) AS v FROM scan GROUP BY doc_id) v ON c.doc_id = v.doc_id""",
    ),
)
def q_file_verdict(spark, sf):
    cf = fx.code_files(spark, sf)
    return P.file_verdict(cf, P.method_flags(cf))


@register(
    "scan_result_flat",
    _sql(_SCAN_CTES, "SELECT doc_id, method_idx, method, vulnerable FROM scan"),
)
def q_scan_result_flat(spark, sf):
    return _scan(spark, sf, line_level=False).select("doc_id", "method_idx", "method", "vulnerable")


@register(
    "flag_count_gate",
    _sql(
        _SCAN_CTES,
        """SELECT c.doc_id, CAST(coalesce(sum(s.vulnerable), 0) AS BIGINT) AS n_flagged, coalesce(sum(s.vulnerable), 0) > 0 AS has_vulnerable
FROM code_files c LEFT JOIN scan s ON s.doc_id = c.doc_id GROUP BY c.doc_id""",
    ),
)
def q_flag_count_gate(spark, sf):
    files = fx.code_files(spark, sf)
    return G.flag_count_gate(files, P.method_flags(files))


@register(
    "evaluate_test",
    _sql(
        _split_scored_ctes("test") + [f"rep AS ({_TEST_REPORT_SQL_BODY})"],
        f"SELECT *, test_f1 > {O.QUALITY} AS passed FROM rep",
    ),
)
def q_evaluate_test(spark, sf):
    return P.evaluate_test(fx.snippets(spark, sf))


@register(
    "score_snippets",
    _sql(
        SN + [O.WEIGHTS, f"su AS (SELECT *, {O.row_hash(['Snippet', 'Target', 'CWE'])} AS row_id FROM snippets)",
                         "sd AS (SELECT DISTINCT row_id, Snippet FROM su)"]
        + O.score_texts_ctes("sd", ["row_id"], "Snippet"),
        "SELECT su.row_id, round(p1, 6) AS p1, pred AS vulnerable FROM su JOIN st_scored USING (row_id)",
    ),
)
def q_score_snippets(spark, sf):
    return P.score_snippets(fx.snippets(spark, sf))


@register(
    "text_checksums",
    "SELECT doc_id, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
)
def q_text_checksums(spark, sf):
    d = fx.documents(spark, sf)
    return d.select(
        "doc_id", F.md5(F.col("text")).alias("md5"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )



# ---------------------------------------------------------------------------
# Sources and sinks (S1-S7), training (C1, S6), batch UDF
# These write to (and read back from) the shared checkpoint folder.
# ---------------------------------------------------------------------------

from ..sources import csv_blocks as CB  # noqa: E402
from ..sources import io as S  # noqa: E402
from ..streaming import changes as CH  # noqa: E402
from ..streaming import scan_stream as ST  # noqa: E402


_WRITTEN_FILES: dict[tuple[str, str], str] = {}


def _materialised_code_files(spark, sf) -> str:
    """The derived code files written as one file per document under the
    shared checkpoint folder; written once per application and input."""
    k = (spark.sparkContext.applicationId, sf)
    if k not in _WRITTEN_FILES:
        path = scratch_path(spark, "code-files")
        S.write_code_files(fx.code_files(spark, sf), path)
        _WRITTEN_FILES[k] = path
    return _WRITTEN_FILES[k]


# Every written file ends with one "\n" after the code.
_WRITTEN = "code || chr(10)"


def _doc_key() -> "F.Column":
    # the file key comes back in the file's path
    return S.file_key().cast("bigint").alias("doc_id")


@register("src_code_files", _sql(CF, f"SELECT doc_id, {_WRITTEN} AS code FROM code_files"))
def q_src_code_files(spark, sf):
    path = _materialised_code_files(spark, sf)
    return S.read_code_files(spark, path).select(_doc_key(), "code")


@register(
    "file_manifest",
    _sql(CF, f"SELECT doc_id, md5({_WRITTEN}) AS md5, CAST(strlen({_WRITTEN}) AS BIGINT) AS size FROM code_files"),
)
def q_file_manifest(spark, sf):
    raw = S.read_code_bytes(spark, _materialised_code_files(spark, sf))
    return S.file_manifest(raw).select(_doc_key(), "md5", "size")


@register("manifest_compare", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def q_manifest_compare(spark, sf):
    """An expected manifest in which every 7th checksum differs, against files of
    which every 11th is missing."""
    files = S.read_code_bytes(spark, _materialised_code_files(spark, sf))
    # both sides of the comparison come from it: the files are read once
    actual = stored(S.file_manifest(files).select(_doc_key(), "md5", "size"), "manifest")
    expected = actual.withColumn("md5", F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 32)).otherwise(F.col("md5")))
    return S.manifest_mismatches(actual.filter("doc_id % 11 <> 0"), expected, "doc_id").select("doc_id")


@register("quarantine_invalid", "SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_bytes FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL")
def q_quarantine_invalid(spark, sf):
    """Files that are not UTF-8 go to the quarantine output; here every 5th text
    with half a character behind it."""
    text = F.encode("text", "UTF-8")
    raw = fx.documents(spark, sf).filter("text is not null").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.unhex(F.lit("C3")))).otherwise(text).alias("content"))
    bad = S.decode_files(raw).filter(~F.col("valid"))
    return bad.select("doc_id", F.octet_length("content").cast("bigint").alias("n_bytes"))


@register("decode_utf8", _sql(CF, f"SELECT doc_id, true AS valid, {_WRITTEN} AS code FROM code_files"))
def q_decode_utf8(spark, sf):
    raw = S.read_code_bytes(spark, _materialised_code_files(spark, sf))
    return S.decode_files(raw).select(_doc_key(), "valid", "code")


@register("src_csv_roundtrip", _sql(SN, "SELECT Snippet, Target, CWE FROM snippets"))
def q_src_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "snippets-csv")
    S.write_snippets_csv(X.project_snippets(fx.snippets(spark, sf)), path)
    return S.read_snippets(spark, path)


@register("src_csv_blocks", _sql(SN, "SELECT Snippet, Target, CWE FROM snippets"))
def q_src_csv_blocks(spark, sf):
    """S1 by blocks: the snippets written as CSV and read again, each file by many tasks."""
    path = scratch_path(spark, "snippets-csv")
    S.write_snippets_csv(X.project_snippets(fx.snippets(spark, sf)), path)
    return CB.read_snippets_blocks(spark, path)


@register(
    "sink_splits",
    _sql(_DS, "SELECT row_id, rnk, split, Snippet, Target, CWE FROM dataset"),
)
def q_sink_splits(spark, sf):
    path = scratch_path(spark, "splits")
    S.write_splits(X.prepare_dataset(fx.snippets(spark, sf)), path)
    parts = [S.read_split(spark, path, p) for p in ("train", "test", "val")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("row_id", "rnk", "split", "Snippet", "Target", "CWE")


@register("train_classifier", _sql(_NB_CTES, "SELECT row_id, label, round(p1, 6) AS p1, pred FROM nb_kept"))
def q_train_classifier(spark, sf):
    rows = P.labelled_tokens(fx.snippets(spark, sf))
    model, _ = P.train_best(rows)
    val = C.apply_model(model, X.select_split(rows, "val"), ["row_id", "label"])
    return val.select("row_id", "label", F.round("p1", 6).alias("p1"), C.threshold_flag(F.col("p1")).alias("pred"))


@register("train_and_eval", _sql(_NB_CTES, O.report_select("nb_kept", "eval", False)))
def q_train_and_eval(spark, sf):
    return P.train_and_eval(fx.snippets(spark, sf))[1]


@register("model_roundtrip", _sql(_NB_CTES, "SELECT row_id, round(p1, 6) AS p1_fitted, round(p1, 6) AS p1_loaded FROM nb_kept"))
def q_model_roundtrip(spark, sf):
    rows = P.labelled_tokens(fx.snippets(spark, sf))
    model, _ = P.train_best(rows)
    path = scratch_path(spark, "model")
    C.save_model(model, path)
    val = X.select_split(rows, "val")
    a = C.apply_model(model, val, ["row_id"]).select("row_id", F.round("p1", 6).alias("p1_fitted"))
    b = C.apply_model(C.load_model(spark, path), val, ["row_id"]).select("row_id", F.round("p1", 6).alias("p1_loaded"))
    return a.join(b, "row_id")


@register("score_batch_udf", _sql(_SC_CTES, "SELECT doc_id, round(p1, 6) AS p1 FROM st_scored"))
def q_score_batch_udf(spark, sf):
    t = _code_tokens(spark, sf).select("doc_id", C.token_count_features("toks").alias("x"))
    score = C.batch_scorer(C.make_fixed_linear_model(), n_features=len(C.FIXED_WEIGHTS))
    return t.select("doc_id", F.round(score("x"), 6).alias("p1"))


@register(
    "stream_scan",
    _sql(_SCAN_CTES, "SELECT doc_id, method_idx, name, method, p1, vulnerable, vul_lines FROM scan"),
)
def q_stream_scan(spark, sf):
    src = _materialised_code_files(spark, sf)
    out = ST.run_scan_stream(
        spark, src, scratch_path(spark, "scan-sink"), scratch_path(spark, "scan-stream-ckpt")
    )
    return out.select(_doc_key(), "method_idx", "name", "method", "p1", "vulnerable", "vul_lines")


@register(
    "scan_changed_files",
    _sql(
        CF,
        "SELECT doc_id, 'added' AS change, md5(code) AS md5 FROM code_files UNION ALL "
        "SELECT doc_id, 'deleted', md5(code) FROM code_files WHERE doc_id % 7 = 0 UNION ALL "
        "SELECT doc_id, 'changed', md5(code || chr(10) || '// v2') FROM code_files WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0",
    ),
)
def q_scan_changed_files(spark, sf):
    """S5 + S7: two snapshots of the code files, the second without every 7th file and with
    every 5th changed; the log of changes, whose added and changed files are scanned."""
    names = ("snapshots", "change-sink", "change-ckpt")
    folder, sink, ckpt = (scratch_path(spark, n) for n in names)
    files = fx.code_files(spark, sf).withColumn("path", F.col("doc_id").cast("string"))
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("code", F.lit("\n// v2"))).otherwise(F.col("code"))
    second = files.filter("doc_id % 7 <> 0").withColumn("code", edited)
    for day, snapshot in enumerate((files, second), 1):
        CH.append_snapshot(snapshot, folder, datetime(2024, 1, day))
        log = CH.run_change_scan(spark, folder, sink, ckpt)
    return log.select(F.col("path").cast("bigint").alias("doc_id"), "change", "md5")
