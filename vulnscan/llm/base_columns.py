"""The columns of operators 4, 5, 7 and 10 that SQL can express, as queries with an oracle.

Each query takes its rows from its operator's own query and leaves out what depends on a
learnt or indexed part (labels and score of 4, bands of 5, voted spans of 7, the
classifier's verdict of 10). The DuckDB statements are written from the definitions of the columns.

Defined cases are those of the operators: a null text or url counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import license_scan, pii, quality_rules, url_filter

_FOLD = f"translate(coalesce({{}}, ''), '{C.UPPER}', '{C.LOWER}')"


def _positions(words: str) -> str:
    """CTEs d(r, doc_id, text, ws) and p(r, i, w): one row a document, one row a word."""
    return f"""d AS (SELECT row_number() OVER () AS r, doc_id, text, {words} AS ws FROM documents),
p AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d)"""


def _next(n: int) -> str:
    return ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, n))


def license_query(spark, sf_dir: str) -> DataFrame:
    return license_scan.query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_ORACLE = f"""WITH {_positions("regexp_extract_all(" + _FOLD.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")},
q AS (SELECT r, i, w, {_next(4)} FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (
  SELECT r, i, 'mit' AS label FROM q WHERE (w, w1, w2, w3) = ('under', 'the', 'mit', 'license')
  UNION ALL SELECT r, i, 'apache-2' FROM q WHERE (w, w1, w2, w3) = ('apache', 'license', 'version', '2')
  UNION ALL SELECT r, i, 'cc-by-nc' FROM q WHERE (w, w1, w2) = ('cc', 'by', 'nc')),
s AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
       coalesce(labels, '') AS base_labels
FROM d LEFT JOIN s USING (r)"""


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality_rules.query(spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WINDOW = " || ' ' || ".join(["w", *[f"w{k}" for k in range(1, 8)]])

QUALITY_ORACLE = rf"""WITH {_positions(_SPACE_WORDS)},
q AS (SELECT r, i, w, {_next(8)} FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, w, w7 IS NOT NULL AND count(*) OVER (PARTITION BY r, {_WINDOW}) > 1 AS again FROM q),
c AS (SELECT r, w, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM g),
s AS (SELECT r, count(*) AS n, sum(length(w)) AS chars, count(*) FILTER (hit) AS rep FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
e AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words
FROM d LEFT JOIN s USING (r) LEFT JOIN e USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a"""


def pii_query(spark, sf_dir: str) -> DataFrame:
    return pii.query(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


#: The contract's kinds in their order: pattern, and what a match must meet besides.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda j:
  (1 + j % 2)
  * CAST(substr(reverse({_DIGITS}), j + 1, 1) AS INTEGER)
  - CASE WHEN j % 2 = 1 AND substr(reverse({_DIGITS}), j + 1, 1) >= '5' THEN 9 ELSE 0 END)) % 10 = 0"""
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)


def _spans(no: int, kind: str, pattern: str, valid: str) -> str:
    """All matches with their starts: the texts between matches and the matches before."""
    return f"""SELECT r, {no} AS no, '{kind}' AS kind, a AS start, a + length(m) AS stop FROM (
  SELECT r, m, sum(length(gap)) OVER (PARTITION BY r ORDER BY j) + sum(length(m)) OVER (PARTITION BY r ORDER BY j) - length(m) AS a
  FROM (SELECT r, unnest(ms) AS m, unnest(range(len(ms))) AS j, unnest(gaps[1:len(ms)]) AS gap
        FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)))
WHERE {valid}"""


PII_ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_spans(no, *kind) for no, kind in enumerate(_KINDS))}),
s AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _KINDS)},
       string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, no) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN s USING (r)"""


def url_query(spark, sf_dir: str) -> DataFrame:
    rows = url_filter.query(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


URL_ORACLE = f"""WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
  ('net/es/', 'block'), ('net/fr/', 'block')),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
u AS (SELECT row_number() OVER () AS r, page_id,
       CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS authority FROM u),
b AS (SELECT r, page_id, {_FOLD.format("authority")} AS host, regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path FROM a),
m AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict
      FROM b JOIN parts ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, rule_verdict FROM b LEFT JOIN m USING (r)"""

QUERIES = {"license_scan_base": license_query, "quality_rules_base": quality_query, "pii_base": pii_query, "url_filter_rules": url_query}
ORACLE = {"license_scan_base": LICENSE_ORACLE, "quality_rules_base": QUALITY_ORACLE, "pii_base": PII_ORACLE, "url_filter_rules": URL_ORACLE}
