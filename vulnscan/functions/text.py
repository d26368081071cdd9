"""Text cleaning as Column -> Column functions.

All of these are built-in Spark expressions, so they run inside whole-stage
codegen on the executors; nothing here calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    COMMENT_RE,
    LITERAL_OR_COMMENT_RE,
    NEWLINE_MARKER,
    SPACE_MARKER,
    TAB_MARKER,
    WS,
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_comments(c: Column | str, literal_safe: bool = False) -> Column:
    """Remove ``/*...*/`` (to the first ``*/``) and ``//`` to end of line.

    Leftmost match wins and string literals are not recognised, so
    ``"http://x"`` is cut, as in the behaviour reproduced; ``literal_safe``
    keeps literals (Q1). An unterminated ``/*`` stays.
    """
    if literal_safe:
        return F.regexp_replace(_c(c), LITERAL_OR_COMMENT_RE, "$1")
    return F.regexp_replace(_c(c), COMMENT_RE, "")


def drop_cr_tab(c: Column | str) -> Column:
    """Delete CR and TAB (deleted, not replaced by a space)."""
    return F.translate(_c(c), "\r\t", "")


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: the 29 whitespace characters, not just U+0020."""
    return F.btrim(_c(c), F.lit(WS))


def nonblank_lines(c: Column | str, drop_directives: bool = False) -> Column:
    """Split on ``\\n``, strip each line, drop blank lines.

    ``drop_directives`` also drops preprocessor lines (``#if`` ...), which
    the method cutter needs before the lines are joined (deviation Q4).
    """
    lines = F.transform(F.split(_c(c), "\n"), strip_ws)
    if drop_directives:
        return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.filter(lines, lambda x: x != "")


def clean_lines(c: Column | str, drop_directives: bool = False, literal_safe: bool = False) -> Column:
    return nonblank_lines(drop_cr_tab(strip_comments(c, literal_safe)), drop_directives)


def clean_single_line(c: Column | str, drop_directives: bool = False, literal_safe: bool = False) -> Column:
    """T4: T1..T3, lines joined with one space."""
    return F.array_join(clean_lines(c, drop_directives, literal_safe), " ")


def clean_multi_line(c: Column | str) -> Column:
    """T5: T1..T3, lines joined with ``\\n``."""
    return F.array_join(clean_lines(c), "\n")


def add_line_delimiters(c: Column | str) -> Column:
    """``;`` -> ``;\\n``, then ``{`` -> ``\\n{\\n``, then ``}`` -> ``}\\n``."""
    out = F.replace(_c(c), F.lit(";"), F.lit(";\n"))
    out = F.replace(out, F.lit("{"), F.lit("\n{\n"))
    return F.replace(out, F.lit("}"), F.lit("}\n"))


def normalise_token(c: Column) -> Column:
    """T7 on one token: drop the space marker, map the tab marker to newline."""
    return F.replace(
        F.replace(c, F.lit(SPACE_MARKER), F.lit("")), F.lit(TAB_MARKER), F.lit(NEWLINE_MARKER)
    )


def normalise_tokens(tokens: Column | str) -> Column:
    """T7 on an array of tokens."""
    return F.transform(_c(tokens), normalise_token)


def token_lines(tokens: Column | str) -> Column:
    """Join all tokens and split on the newline marker."""
    return F.split(F.array_join(_c(tokens), ""), NEWLINE_MARKER)


def decode_utf8(content: Column | str) -> Column:
    """Strict UTF-8 decode; invalid input gives NULL (quarantine it)."""
    b = _c(content)
    return F.when(F.is_valid_utf8(b), F.decode(b, "UTF-8"))
