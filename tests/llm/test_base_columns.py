"""The DuckDB statements of the base columns against plain Python, on the edge rows.

The operators are compared with the same plain Python in ``test_edge_cases``, and the
queries with these statements in ``test_pipeline``."""

import brute
import duckdb
import pandas as pd
import pytest
from llm_conftest import edge_rows

from vulnscan.llm import base_columns

MORE = [
    (30, "4111-1111 1111 1111 and 4111 1111 1111 1112, 0000 0000 0000 , 5500000000000004x"),
    (31, "+1 23 45678 90 é +123456789) +(12) 1.2.3.4.5 001.002.000255.4 1.2.3.99999999999999999999999999"),
    (32, "é日本 a@b.c a@b.c, x@y.z.\na@@b.c 😀 q@r.st"),
    (33, "under the mit license cc by nc under the mit license apache license version 2 apache license version 20"),
    (34, "one two three four five six seven eight one two three four five six seven eight nine"),
    (35, "a b c d e f g h " * 3),
]
ROWS = [r for r in edge_rows() if "\x00" not in (r[1] or "")] + MORE


def _run(sql, table, rows, columns):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=columns).astype({columns[0]: "Int64"}))
    con.execute(f"CREATE TABLE {table} AS SELECT {columns[0]}, CAST({columns[1]} AS VARCHAR) AS {columns[1]} FROM given")
    return sorted(con.execute(sql).fetchall(), key=repr)


@pytest.mark.parametrize(("name", "model"), [
    ("license_scan_base", brute.license_base),
    ("quality_rules_base", brute.quality_base),
    ("pii_base", brute.pii_row),
])
def test_document_statements(name, model):
    got = _run(base_columns.ORACLE[name], "documents", ROWS, ["doc_id", "text"])
    assert got == sorted(((k, *model(t)) for k, t in ROWS), key=repr)
    assert _run(base_columns.ORACLE[name], "documents", [], ["doc_id", "text"]) == []


def test_url_statement():
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "https://www.EXAMPLE.com/en/", "http://example.com",
            "http://example.com?/en/", "x://q.net/es/1", "x://net/fr/", "x://network/fr/", "http://a.org/#/en/", "a://b://c/d",
            "http://h\n.com/en\n/x", "http://É.com/de", "http://notexample.com/en/", "http://www.example.com/en/a", "http://x.www.example.com/en/"]
    got = _run(base_columns.ORACLE["url_filter_rules"], "pages", list(enumerate(urls)), ["page_id", "url"])
    assert got == sorted(((i, *brute.url_parts(u)) for i, u in enumerate(urls)), key=repr)
