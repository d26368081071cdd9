"""DuckDB spelling of every query with an oracle (the correctness gate).

Built from the same fixed values and regexes as the Spark side. Tables
``documents``, ``labels``, ... are views provided by the checker. DuckDB
notes: ``regexp_replace`` needs ``'g'`` to replace all; the new lambda
syntax is ``lambda x: ...``; ``('0x' || hex)::BIGINT`` parses hex.
"""

from __future__ import annotations

from ..functions.constants import (
    ARROW,
    BLOCK_SIZE,
    BRACKETS,
    CLS_TOKEN,
    CODE_TOKEN_RE2,
    COMMENT_RE,
    CONDITION_OPERATORS,
    CONDITION_PAIRS,
    CONDITION_TEXTS,
    CONDITION_TOKEN_RE,
    DIRECTIVE_RE,
    FIRST_WORD_RE,
    FIXED_BIAS,
    FIXED_WEIGHTS,
    HEADER_MARKS,
    HOLD_FRACTION_VAL,
    LITERAL_TOKEN_RE,
    LINE_SEPARATORS,
    METHOD_SIG_RE2,
    MODIFIERS_RE2,
    NEWLINE_MARKER,
    NOT_METHOD_WORDS,
    OPERATOR_RE,
    PAD_ID,
    PARSE_TOKEN_RE2,
    PROSE_KEEP_RE,
    QUALITY_F1,
    SEED,
    SEP_TOKEN,
    SPACE_MARKER,
    TAB_MARKER,
    THRESHOLD,
    TOP_LINES,
    TRAIN_FRACTION_HOLD,
    TYPE_HEADER_RE,
    UNK_ID,
    WS,
)


def q(s: str) -> str:
    """SQL string literal; non-printable characters spelled with chr()."""
    parts, buf = [], []
    for ch in s:
        if ch.isprintable() and ord(ch) < 0x80:
            buf.append("''" if ch == "'" else ch)
        else:
            if buf:
                parts.append("'" + "".join(buf) + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append("'" + "".join(buf) + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


WS_SQL = q(WS)
CRLF = "chr(13) || chr(10)"


# ---------------------------------------------------------------------------
# Text functions
# ---------------------------------------------------------------------------


def strip_comments(x: str) -> str:
    return f"regexp_replace({x}, {q(COMMENT_RE)}, '', 'g')"


def drop_cr_tab(x: str) -> str:
    return f"replace(replace({x}, chr(13), ''), chr(9), '')"


def nonblank_lines(x: str, drop_directives: bool = False) -> str:
    keep = "l <> '' and not starts_with(l, '#')" if drop_directives else "l <> ''"
    return (
        f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l, {WS_SQL})), "
        f"lambda l: {keep})"
    )


def clean_lines(x: str, drop_directives: bool = False) -> str:
    return nonblank_lines(drop_cr_tab(strip_comments(x)), drop_directives)


def clean_single_line(x: str, drop_directives: bool = False) -> str:
    return f"array_to_string({clean_lines(x, drop_directives)}, ' ')"


def clean_multi_line(x: str) -> str:
    return f"array_to_string({clean_lines(x)}, chr(10))"


def add_line_delimiters(x: str) -> str:
    return (
        f"replace(replace(replace({x}, ';', ';' || chr(10)), '{{', chr(10) || '{{' || chr(10)), "
        f"'}}', '}}' || chr(10))"
    )


def tokenize_code(x: str) -> str:
    return (
        f"list_transform(regexp_extract_all({x}, {q(CODE_TOKEN_RE2)}, 0), "
        f"lambda t: CASE WHEN t = chr(10) THEN {q(NEWLINE_MARKER)} ELSE t END)"
    )


def with_markers(x: str) -> str:
    return f"list_concat([{q(CLS_TOKEN)}], {x}, [{q(SEP_TOKEN)}])"


def hex_int(x: str, n: int) -> str:
    return f"('0x' || substr({x}, 1, {n}))::BIGINT"


# ---------------------------------------------------------------------------
# Derived tables (FIXTURES)
# ---------------------------------------------------------------------------

_BODY = f"replace(regexp_replace(text, {q(PROSE_KEEP_RE)}, '', 'g'), chr(10), ';' || {CRLF} || chr(9))"
# one more member in seven files of eight: (text, method names)
EXTRA_MEMBERS = (
    ("", ()),
    ("int Sq(int x) => x switch { 0 => 1, _ => x };", ("Sq",)),
    ('[Route("[a]/{id}")] Task<(int a, int b)> Pair(string s = ")") { int Loc(int y) { return y; } return Loc(1); }', ("Pair",)),
    ('byte* Ptr(byte* a) { var t = $"{(a == null ? "{" : "b")}"; return a; }', ("Ptr",)),
    ("IEnumerator<int> IEnumerable<int>.GetEnumerator() => new Foo { A = 1 };", ("GetEnumerator",)),
    ("file class In { Map<string, List<(int, Func<A<B<C<D<E[]>>>>, (int, int)>)>> Deep<T>(List<T> a) where T : new() { return null; } }", ("Deep",)),
    ("void Host() { class In { int Held() { return 1; } } }", ("Host",)),  # a candidate inside another
    ("bool Cmp(int a = 1 << 2, [In] int b = 3) { return a > b; } }", ("Cmp",)),  # one brace too many
)
# files without a method: a byte order mark and a bare block
METHODLESS = "doc_id % 7 = 3"
_EXTRA = "CASE " + " ".join(f"WHEN doc_id % {len(EXTRA_MEMBERS)} = {i} THEN {q(t)}" for i, (t, _) in enumerate(EXTRA_MEMBERS)) + " END"
CODE_FILES = f"""code_files AS (
  SELECT doc_id, CASE WHEN {METHODLESS} THEN concat(chr(65279), '{{', {CRLF}, {_BODY}, {CRLF}, '}}', {CRLF}) ELSE concat(
    '/* ', source, {CRLF}, ' * // ', lang, ' */', {CRLF},
    'namespace N', {CRLF}, '{{', {CRLF},
    'class C', CAST(doc_id AS VARCHAR), {CRLF}, '{{', {CRLF},
    chr(9), 'public C', CAST(doc_id AS VARCHAR), '(int k) {{ this.k = k; }}', {CRLF},
    chr(9), 'public override void Bad(string a)', {CRLF}, chr(9), '{{', {CRLF},
    chr(9), chr(9), 'if (a != null) {{ // http://', source, {CRLF},
    {_BODY},
    '; }}', {CRLF}, chr(9), '}}', {CRLF},
    'private int Good() {{ return ', CAST(n_chars AS VARCHAR), '; }}', {CRLF},
    {_EXTRA}, {CRLF},
    '}}', {CRLF}, '}}', {CRLF}) END AS code
  FROM documents)"""

# conditional lines before the method Good, by form; the symbols that are set; the names
# of the methods that then stand
BRANCHES = (
    ("", ()),
    ("#if DEBUG && !(LEGACY || TRACE == false)\nint Pick(int a) {\n#elif LEGACY\nint Pick(long a) {\n#else\nlong Other() {\n#endif\nreturn 1; }\n", ("Pick",)),
    ("#if LEGACY\nvoid Old() { }\n#if DEBUG\nvoid OldDebug() { }\n#endif\n#else\n# if DEBUG != LEGACY\nvoid New() {\n# else\nvoid Plain() {\n# endif\n}\n#endif\n", ("New",)),
    ("#region x\n#if (!OMIT) // y\nvoid Kept() { }\n#endif\n#endregion\n", ("Kept",)),
)
SYMBOLS = ("DEBUG", "TRACE")
BRANCH_FILES = f"""branch_files AS (
  SELECT doc_id, replace(code, 'private int Good()', CASE {" ".join(f"WHEN doc_id % {len(BRANCHES)} = {i} THEN {q(t)}" for i, (t, _) in enumerate(BRANCHES))} END || 'private int Good()') AS code
  FROM code_files)"""

SNIPPETS = """sn_base AS (
  SELECT c.doc_id, c.code AS Snippet, CAST(l.toxic AS INTEGER) AS Target,
         CASE WHEN c.doc_id % 3 = 0 THEN NULL
              ELSE concat('CWE-', CAST(70 + c.doc_id % 20 AS VARCHAR)) END AS CWE
  FROM code_files c JOIN labels l ON c.doc_id = l.doc_id),
snippets AS (
  SELECT Snippet, Target, CWE FROM sn_base
  UNION ALL
  SELECT Snippet, Target, CWE FROM sn_base WHERE doc_id % 10 = 0)"""

PREDS = f"""preds AS (
  SELECT doc_id, {hex_int("md5(concat('p', CAST(doc_id AS VARCHAR)))", 6)} / 16777216.0::DOUBLE AS p1,
         CAST(toxic AS INTEGER) AS label
  FROM labels)"""

TOKENS = f"""tk_words AS (
  SELECT doc_id, string_split(replace(text, chr(10), ' ' || {q(NEWLINE_MARKER)} || ' '), ' ') AS w
  FROM documents),
tk_pos AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM tk_words),
tokens AS (
  SELECT doc_id, pos, token,
         {hex_int("md5(concat(CAST(doc_id AS VARCHAR), '-', CAST(pos AS VARCHAR)))", 2)} % 4 AS score
  FROM tk_pos WHERE token <> '')"""

HEADS, PROBES = 2, 2
# stands after TOKENS
ATTENTION = f"""attention AS (
  SELECT doc_id, head, q, pos AS k,
         {hex_int("md5(concat_ws('-', CAST(doc_id AS VARCHAR), CAST(head AS VARCHAR), CAST(q AS VARCHAR), CAST(pos AS VARCHAR)))", 2)} AS w
  FROM tokens, (SELECT unnest(range(0, {HEADS})) AS head) h, (SELECT unnest(range(0, {PROBES})) AS q) p)"""

WEIGHTS = "weights AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {w!r}::DOUBLE)" for t, w in FIXED_WEIGHTS
) + ") v(token, w))"

SEPS_SQL = "(" + ", ".join(q(s) for s in LINE_SEPARATORS) + ")"


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# Method extraction (M1-M5)
# ---------------------------------------------------------------------------


def signature(h: str) -> str:
    bare = f"replace(translate({h}, {q(HEADER_MARKS)}, ''), '::', '.')"
    return f"regexp_replace(trim({bare}, {WS_SQL}), {q(MODIFIERS_RE2)}, '')"


def is_method_signature(sig: str) -> str:
    words = ", ".join(q(w) for w in NOT_METHOD_WORDS)
    return (
        f"(regexp_matches({sig}, {q(METHOD_SIG_RE2)}) AND regexp_extract({sig}, {q(FIRST_WORD_RE)}, 1) NOT IN ({words})"
        f" AND NOT regexp_matches({sig}, {q(OPERATOR_RE)}))"
    )


def method_name(sig: str) -> str:
    return f"regexp_extract({sig}, {q(METHOD_SIG_RE2)}, 1)"


PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
CUR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def method_ctes(src: str = "code_files", key: str = "doc_id", code: str = "code") -> list[str]:
    """CTEs mt_tok .. mt_methods; the depths are counted anew in each segment."""
    delta = lambda a, b: f"CASE WHEN tok = '{a}' THEN 1 WHEN tok = '{b}' THEN -1 ELSE 0 END"
    in_seg = f"OVER (PARTITION BY k, seg ORDER BY i {PREV})"
    brackets = ", ".join(q(x) for x in BRACKETS)
    n = len(ARROW)
    return [
        f"""mt_src AS (SELECT {key} AS k, regexp_extract_all({clean_single_line(code, True)}, {q(PARSE_TOKEN_RE2)}, 0) AS toks FROM {src})""",
        """mt_tok AS (SELECT k, unnest(toks) AS tok, unnest(range(0, len(toks))) AS i FROM mt_src)""",
        f"""mt_tok2 AS (SELECT *,
   coalesce(sum({delta('(', ')')}) OVER (PARTITION BY k ORDER BY i {PREV}), 0) AS pdepth,
   coalesce(sum(length(tok)) OVER (PARTITION BY k ORDER BY i {PREV}), 0) AS off
 FROM mt_tok)""",
        """mt_tok3 AS (SELECT *, (tok IN ('{', '}', ';') AND pdepth <= 0) AS is_delim FROM mt_tok2)""",
        f"""mt_tok4 AS (SELECT *, coalesce(sum(CASE WHEN is_delim THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i {PREV}), 0) AS seg FROM mt_tok3)""",
        f"""mt_tok5 AS (SELECT *, coalesce(sum({delta('(', ')')}) {in_seg}, 0) AS rel FROM mt_tok4)""",
        f"""mt_tok6 AS (SELECT *, coalesce(sum(CASE WHEN rel = 0 THEN {delta('[', ']')} END) {in_seg}, 0) AS sq,
   coalesce(sum(CASE WHEN rel = 0 THEN {delta('<', '>')} END) {in_seg}, 0) AS ang,
   rel = 0 AND ends_with(tok, {q(ARROW)}) AS is_arrow FROM mt_tok5)""",
        """mt_tok7 AS (SELECT *, min(CASE WHEN is_arrow THEN i END) OVER (PARTITION BY k, seg) AS arrow FROM mt_tok6)""",
        f"""mt_tok8 AS (SELECT *, CASE WHEN is_delim OR i > arrow OR sq <> 0 OR ang <> 0 OR tok IN ({brackets}) OR NOT (rel = 0 OR rel = 1 AND tok = ')') THEN ''
   WHEN i = arrow THEN tok[:-{n + 1}] WHEN regexp_matches(tok, {q(LITERAL_TOKEN_RE)}) THEN '0' ELSE tok END AS piece FROM mt_tok7)""",
        f"""mt_seg AS (SELECT k, seg, string_agg(tok, '' ORDER BY i) AS text, {signature("string_agg(piece, '' ORDER BY i)")} AS sig, min(off) AS off,
   max(CASE WHEN is_delim THEN tok END) AS delim, max(arrow) IS NOT NULL AS has_arrow FROM mt_tok8 GROUP BY k, seg)""",
        f"""mt_lv AS (SELECT *, coalesce(sum(CASE WHEN delim = '{{' THEN 1 WHEN delim = '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seg {PREV}), 0) AS bd_before FROM mt_seg)""",
        """mt_lv2 AS (SELECT *, CASE WHEN delim = '{' THEN bd_before + 1 WHEN delim = '}' THEN bd_before END AS level FROM mt_lv)""",
        """mt_pair AS (SELECT *,
   CASE WHEN delim = '{' AND lead(delim) OVER (PARTITION BY k, level ORDER BY seg) = '}' THEN lead(seg) OVER (PARTITION BY k, level ORDER BY seg) END AS partner,
   CASE WHEN delim = '{' AND lead(delim) OVER (PARTITION BY k, level ORDER BY seg) = '}' THEN lead(off + length(text)) OVER (PARTITION BY k, level ORDER BY seg) END AS partner_stop
 FROM mt_lv2)""",
        f"""mt_role AS (SELECT k, seg, bd_before AS d, NULL::BOOLEAN AS ty, delim FROM mt_pair
 UNION ALL SELECT k, seg, level, regexp_matches(sig, {q(TYPE_HEADER_RE)}), delim FROM mt_pair WHERE delim = '{{')""",
        f"""mt_ctx0 AS (SELECT *, coalesce(last_value(ty IGNORE NULLS) OVER (PARTITION BY k, d ORDER BY seg {CUR}), false) AS in_type,
   min(CASE WHEN delim = ';' AND ty IS NULL THEN seg END) OVER (PARTITION BY k, d ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS semi_end
 FROM mt_role)""",
        """mt_ctx AS (SELECT s.*, c.in_type, c.semi_end FROM mt_pair s JOIN mt_ctx0 c ON s.k = c.k AND s.seg = c.seg AND c.ty IS NULL)""",
        """mt_end AS (SELECT *, CASE WHEN delim = ';' THEN seg WHEN delim = '{' AND has_arrow THEN semi_end WHEN delim = '{' THEN partner END AS stop_seg FROM mt_ctx)""",
        f"""mt_form AS (SELECT *, sig AS header, coalesce(in_type AND stop_seg IS NOT NULL AND {is_method_signature('sig')}, false) AS cand FROM mt_end)""",
        """mt_cand AS (SELECT *, CASE WHEN cand THEN stop_seg END AS cand_end FROM mt_form)""",
        f"""mt_kept AS (SELECT *, cand AND (max(cand_end) OVER (PARTITION BY k ORDER BY seg {PREV}) IS NULL
                         OR seg > max(cand_end) OVER (PARTITION BY k ORDER BY seg {PREV})) AS kept FROM mt_cand)""",
        f"""mt_tag AS (SELECT *,
   max(CASE WHEN kept THEN seg END) OVER (PARTITION BY k ORDER BY seg {CUR}) AS m_start,
   max(CASE WHEN kept THEN cand_end END) OVER (PARTITION BY k ORDER BY seg {CUR}) AS m_end
 FROM mt_kept)""",
        """mt_grp AS (SELECT k, m_start, string_agg(text, '' ORDER BY seg) AS raw, min(off) AS seg_off,
   max(off + length(text)) AS stop, max(CASE WHEN kept THEN header END) AS header
 FROM mt_tag WHERE m_start IS NOT NULL AND seg <= m_end GROUP BY k, m_start)""",
        f"""mt_methods AS (SELECT k AS {key}, CAST(row_number() OVER (PARTITION BY k ORDER BY m_start) - 1 AS BIGINT) AS method_idx,
   {method_name("header")} AS name,
   CAST(seg_off + length(raw) - length(ltrim(raw, {WS_SQL})) AS BIGINT) AS start_pos,
   CAST(stop - 1 AS BIGINT) AS end_pos,
   {add_line_delimiters(f"ltrim(raw, {WS_SQL})")} AS method
 FROM mt_grp)""",
    ]


def _condition_step(e: str) -> str:
    for text, value in CONDITION_TEXTS:
        e = f"replace({e}, {q(text)}, {q(value)})"
    for pattern, value in CONDITION_PAIRS:
        e = f"regexp_replace({e}, {q(pattern)}, {q(chr(92) + '1' + value + chr(92) + '2')}, 'g')"
    return e


def branch_ctes(src: str, key: str = "doc_id", code: str = "code") -> list[str]:
    """br_code(key, code): the lines that stand for SYMBOLS. Needs WITH RECURSIVE."""
    known = ", ".join(q(x) for x in (*SYMBOLS, "true"))
    marks = " ".join(f"WHEN t = {q(w)} THEN {q(m)}" for w, m in CONDITION_OPERATORS.items())
    encoded = (
        f"array_to_string(list_transform(regexp_extract_all(rest, {q(CONDITION_TOKEN_RE)}), lambda t: CASE WHEN t IN ({known}) THEN '1' "
        f"{marks} WHEN regexp_matches(t, '^[\\p{{L}}_]') THEN '0' ELSE t END), '')"
    )
    return [
        f"br_src AS (SELECT {key} AS k, {clean_lines(code)} AS ls FROM {src})",
        "br_line AS (SELECT k, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM br_src)",
        f"br_word AS (SELECT *, regexp_extract(l, {q(DIRECTIVE_RE)}, 1) AS word, regexp_extract(l, {q(DIRECTIVE_RE)}, 2) AS rest FROM br_line)",
        f"br_cond AS (SELECT DISTINCT rest, {encoded} AS e FROM br_word WHERE word IN ('if', 'elif'))",
        f"br_eval AS (SELECT rest, e FROM br_cond UNION SELECT rest, {_condition_step('e')} FROM br_eval WHERE length(e) > 1)",
        """br_level AS (SELECT b.*, word = 'else' OR coalesce(v.e = '1', false) AS holds, CASE WHEN word <> '' THEN
   sum(CASE word WHEN 'if' THEN 1 WHEN 'endif' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) + CASE WHEN word = 'endif' THEN 1 ELSE 0 END END AS lv
 FROM br_word b LEFT JOIN (SELECT rest, e FROM br_eval WHERE e = '1') v ON b.word IN ('if', 'elif') AND v.rest = b.rest)""",
        "br_which AS (SELECT *, sum(CASE WHEN word = 'if' THEN 1 ELSE 0 END) OVER (PARTITION BY k, lv ORDER BY i) AS wh FROM br_level)",
        f"""br_dead AS (SELECT *, CASE WHEN word IN ('if', 'elif', 'else') AND (NOT holds
   OR coalesce(bool_or(holds) OVER (PARTITION BY k, lv, wh ORDER BY i {PREV}), false)) THEN 1 ELSE 0 END AS dead FROM br_which)""",
        "br_change AS (SELECT *, CASE WHEN word <> '' THEN dead - coalesce(lag(dead) OVER (PARTITION BY k, lv, wh ORDER BY i), 0) ELSE 0 END AS change FROM br_dead)",
        "br_out AS (SELECT *, sum(change) OVER (PARTITION BY k ORDER BY i) AS out FROM br_change)",
        f"br_code AS (SELECT k AS {key}, string_agg(l, chr(10) ORDER BY i) AS code FROM br_out WHERE out = 0 AND NOT starts_with(l, '#') GROUP BY k)",
    ]


# ---------------------------------------------------------------------------
# Line attribution
# ---------------------------------------------------------------------------


def attribution_ctes(src: str, keys: list[str], padding: bool, prefix: str = "la") -> list[str]:
    """CTEs {prefix}_mask .. {prefix}_top over src(keys, pos, token, score)."""
    ks = ", ".join(keys)
    last = (
        f"max(CASE WHEN s1 <> 0 THEN pos END) OVER (PARTITION BY {ks})"
        if padding
        else f"max(pos) OVER (PARTITION BY {ks})"
    )
    return [
        f"""{prefix}_m1 AS (SELECT {ks}, pos, token, CASE WHEN pos = min(pos) OVER (PARTITION BY {ks}) THEN 0 ELSE score END AS s1 FROM {src})""",
        f"""{prefix}_mask AS (SELECT {ks}, pos, token, CASE WHEN pos = {last} THEN 0 ELSE s1 END AS score FROM {prefix}_m1)""",
        f"""{prefix}_g AS (SELECT {ks}, pos, token, score,
   coalesce(sum(CASE WHEN token IN {SEPS_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY {ks} ORDER BY pos {PREV}), 0) AS g,
   pos = max(pos) OVER (PARTITION BY {ks}) AS is_last
 FROM {prefix}_mask)""",
        f"""{prefix}_grp AS (SELECT {ks}, g,
   sum(CASE WHEN token NOT IN {SEPS_SQL} AND NOT is_last THEN score ELSE 0 END) AS content,
   sum(score) AS total
 FROM {prefix}_g GROUP BY {ks}, g)""",
        f"""{prefix}_lines AS (SELECT {ks}, CAST(row_number() OVER (PARTITION BY {ks} ORDER BY g) - 1 AS BIGINT) AS line_idx, total AS score
 FROM {prefix}_grp WHERE content <> 0)""",
        f"""{prefix}_rank AS (SELECT *, CAST(row_number() OVER (PARTITION BY {ks} ORDER BY score DESC, line_idx ASC) AS BIGINT) AS rnk FROM {prefix}_lines)""",
        f"""{prefix}_top AS (SELECT {ks}, string_agg(CAST(line_idx AS VARCHAR), ',' ORDER BY rnk) AS vul_lines
 FROM {prefix}_rank WHERE rnk <= {TOP_LINES} GROUP BY {ks})""",
    ]


# ---------------------------------------------------------------------------
# Dataset (X1-X5)
# ---------------------------------------------------------------------------


def row_hash(cols: list[str], seed: int = SEED) -> str:
    parts = " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols)
    return f"md5('{seed};' || {parts})"


def split_ctes() -> list[str]:
    """ds_uniq .. dataset (row_id, rnk, split, Snippet, Target, CWE)."""
    n_hold = f"CAST(ceil({TRAIN_FRACTION_HOLD}::DOUBLE * n) AS BIGINT)"
    n_val = f"CAST(ceil({HOLD_FRACTION_VAL}::DOUBLE * {n_hold}) AS BIGINT)"
    return [
        "ds_uniq AS (SELECT DISTINCT Snippet, Target, CWE FROM snippets)",
        f"ds_h AS (SELECT *, {row_hash(['Snippet', 'Target', 'CWE'])} AS row_id FROM ds_uniq)",
        """ds_r AS (SELECT *, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS rnk, count(*) OVER () AS n FROM ds_h)""",
        f"""dataset AS (SELECT row_id, rnk,
   CASE WHEN rnk < n - {n_hold} THEN 'train'
        WHEN rnk < n - {n_hold} + ({n_hold} - {n_val}) THEN 'test'
        ELSE 'val' END AS split,
   Snippet, Target, CWE FROM ds_r)""",
    ]


def score_texts_ctes(src: str, keys: list[str], text: str, prefix: str = "st") -> list[str]:
    """{prefix}_scored (keys, logit0, logit1, p1, pred) for texts of src."""
    ks = ", ".join(keys)
    return [
        f"""{prefix}_tl AS (SELECT {ks}, {tokenize_code(clean_multi_line(text))} AS toks FROM {src})""",
        f"""{prefix}_t AS (SELECT {ks}, unnest(CASE WHEN len(toks) = 0 THEN [NULL::VARCHAR] ELSE toks END) AS token FROM {prefix}_tl)""",
        f"""{prefix}_z AS (SELECT {ks}, sum(coalesce(w.w, 0.0)) AS z FROM {prefix}_t LEFT JOIN weights w USING (token) GROUP BY {ks})""",
        f"""{prefix}_l AS (SELECT {ks}, 0.0::DOUBLE AS logit0, z + ({FIXED_BIAS})::DOUBLE AS logit1 FROM {prefix}_z)""",
        f"""{prefix}_scored AS (SELECT *, {softmax_p1('logit0', 'logit1')} AS p1,
   {threshold_flag(softmax_p1('logit0', 'logit1'))} AS pred FROM {prefix}_l)""",
    ]


def softmax_p1(l0: str, l1: str) -> str:
    m = f"greatest({l0}, {l1})"
    return f"(exp({l1} - {m}) / (exp({l0} - {m}) + exp({l1} - {m})))"


def row_log_loss(l0: str, l1: str, label: str) -> str:
    m = f"greatest({l0}, {l1})"
    return f"({m} + ln(exp({l0} - {m}) + exp({l1} - {m})) - CASE WHEN {label} = 1 THEN {l1} ELSE {l0} END)"


def threshold_flag(p: str, t: float = THRESHOLD) -> str:
    return f"CAST(CASE WHEN {p} > {t} AND NOT isnan({p}) THEN 1 ELSE 0 END AS INTEGER)"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"


def report_select(src: str, prefix: str, with_counts: bool, label: str = "label", pred: str = "pred") -> str:
    cnt = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    inner = f"""SELECT {cnt(f'{label} <> 1 AND {pred} <> 1')} AS TN, {cnt(f'{label} <> 1 AND {pred} = 1')} AS FP,
   {cnt(f'{label} = 1 AND {pred} <> 1')} AS FN, {cnt(f'{label} = 1 AND {pred} = 1')} AS TP,
   coalesce(sum(loss), 0.0) AS loss_sum FROM {src}"""
    cols = [
        f"{div('TP', 'TP + FN')} AS {prefix}_recall",
        f"{div('TP', 'TP + FP')} AS {prefix}_precision",
        f"{div('2 * TP', '2 * TP + FP + FN')} AS {prefix}_f1",
        f"{THRESHOLD}::DOUBLE AS {prefix}_threshold",
        f"round(loss_sum, 6) AS {prefix}_loss",
    ]
    if with_counts:
        cols += ["TP", "FP", "TN", "FN"]
    return f"SELECT {', '.join(cols)} FROM ({inner}) c"


QUALITY = QUALITY_F1
BLOCK = BLOCK_SIZE
PAD = PAD_ID
UNK = UNK_ID
MARKERS = (SPACE_MARKER, TAB_MARKER)
