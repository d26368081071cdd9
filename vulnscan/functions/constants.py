"""Fixed values.

Everything in the first block must keep these exact values for results to
agree with the behaviour being reproduced (comment syntax, Python's
whitespace set, token markers, block size, threshold, ranked-line count,
seed). The second block holds the regular expressions of this library; each
is written so that Java regex (Spark) and RE2 (DuckDB oracle) agree on it:
no lookaround, no backreferences, ``\\w``/``\\s`` avoided.

Java matches a repeated group by recursion and overflows its stack on a long
literal, unless the repetition is possessive. So repeated groups are written
``*P``/``+P`` and spelled possessive for Java and plain for RE2 (which is linear
and knows no possessive form); each group excludes what must follow it, so both
spellings match the same text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour).
# ---------------------------------------------------------------------------

# Block comment up to the first "*/" (lazy), or line comment up to "\n".
# A "." would stop at "\r", U+0085, U+2028 in Java: "[^\n]" does not.
COMMENT_RE = r"(?s:/\*.*?\*/)|//[^\n]*"

# Python str.strip() whitespace: 29 characters, in code point order.
WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SPACE_MARKER = "\u0120"  # "Ġ": subword space marker
TAB_MARKER = "\u0109"  # "ĉ"
NEWLINE_MARKER = "\u010a"  # "Ċ"
# Tokens that end a line in the line-score fold.
LINE_SEPARATORS = ("\u010a", " \u010a", "\u010a\u010a", " \u010a\u010a")

CLS_TOKEN, PAD_TOKEN, SEP_TOKEN, UNK_TOKEN = "<s>", "<pad>", "</s>", "<unk>"
CLS_ID, PAD_ID, SEP_ID, UNK_ID = 0, 1, 2, 3
N_RESERVED_IDS = 4

BLOCK_SIZE = 512  # ids per example, markers included
THRESHOLD = 0.5  # p1 > THRESHOLD  ->  vulnerable (strict)
TOP_LINES = 10  # ranked lines kept per flagged method
SEED = 42
TRAIN_FRACTION_HOLD = 0.3  # first split: 30 % held out
HOLD_FRACTION_VAL = 0.5  # second split of the held-out part
QUALITY_F1 = 0.8  # quality gate: F1 > 0.8

# Fixed linear scorer used by the scan and evaluation queries.
FIXED_WEIGHTS = (("override", 1.5), ("null", 0.8), ("private", -1.0), ("return", -0.5))
FIXED_BIAS = -1.0

# ---------------------------------------------------------------------------
# Regular expressions of this library (same text for Spark and DuckDB).
# ---------------------------------------------------------------------------

_STR = r'"(?:[^"\\]|\\[^\n])*P"'  # "..." with backslash escapes
_VSTR = r'@"(?:[^"]|"")*P"'  # @"..." with "" escapes
_CHR = r"'(?:[^'\\]|\\[^\n])*P'"  # '.'
# $"..." and $@"...": doubled braces, and holes {...} that may hold plain string literals
_HOLE = r'\{(?:[^{}"]|"(?:[^"\\]|\\[^\n])*P")*P\}'
_ISTR = r'\$"(?:[^"\\{]|\\[^\n]|\{\{|' + _HOLE + r')*P"'
_IVSTR = r'(?:\$@|@\$)"(?:[^"{]|""|\{\{|' + _HOLE + r')*P"'


def java(pattern: str) -> str:
    return pattern.replace("*P", "*+").replace("+P", "++")


def re2(pattern: str) -> str:
    return pattern.replace("*P", "*").replace("+P", "+")


# Structural tokenizer for method extraction. Concatenating all matches gives
# the input back: literals, runs that end in an arrow, single structural characters,
# maximal plain runs, and any other single character.
_RUN = r"""[^{};()\[\]<>"'@$]"""
_PARSE_TOKEN = "|".join(
    [_IVSTR, _ISTR, _VSTR, _STR, _CHR, _RUN + r"*[=-]>", r"[{};()\[\]<>]", _RUN + "+", r"(?s:.)"]
)
ARROW = "=>"  # ends the token before an expression body
BRACKETS = ("[", "]", "<", ">")
LITERAL_TOKEN_RE = r"""^[@$]*["'].+"""  # a token of more than the quote is a literal

# A comment, or a literal that may hold what looks like one (group 1, kept).
_LITERAL_OR_COMMENT = "(" + "|".join([_IVSTR, _ISTR, _VSTR, _STR, _CHR]) + ")|" + COMMENT_RE
PARSE_TOKEN_RE, PARSE_TOKEN_RE2 = java(_PARSE_TOKEN), re2(_PARSE_TOKEN)
LITERAL_OR_COMMENT_RE = java(_LITERAL_OR_COMMENT)

_ID = r"[\p{L}_][\p{L}\p{N}_]*"
_QID = _ID + r"(?:\." + _ID + r")*P"

# A header is reduced to its tokens outside attributes, array ranks, type arguments and
# parameter lists (the parentheses stay, empty); these marks go from what is left.
HEADER_MARKS = "*?"

# A method signature of a reduced header without modifiers:
# <return type> [<interface>.]<name>() [where ...]
_METHOD_SIG = r"^(?:\(\)|" + _QID + ") +(?:" + _ID + r"\.)*P(" + _ID + r") *\(\)(?: +where .*)?$"
METHOD_SIG_RE, METHOD_SIG_RE2 = java(_METHOD_SIG), re2(_METHOD_SIG)
# A reduced header that opens a type body.
TYPE_HEADER_RE = r"^(?:class|struct|interface|record)(?:[^\p{L}\p{N}_]|$)"
MODIFIERS = (
    "public private protected internal static virtual override abstract sealed "
    "async extern unsafe new readonly partial volatile const implicit explicit ref "
    "file required"
).split()
_MODIFIERS = "^(?:(?:" + "|".join(MODIFIERS) + ") +)*P"
MODIFIERS_RE, MODIFIERS_RE2 = java(_MODIFIERS), re2(_MODIFIERS)
FIRST_WORD_RE = "^(" + _ID + ")"
# A first word from this list means the header is a statement or a type.
NOT_METHOD_WORDS = (
    "if for foreach while switch using lock catch fixed return new else do try "
    "throw await yield goto case class struct interface enum record namespace "
    "delegate"
).split()
OPERATOR_RE = r"(?:^|[^\p{L}\p{N}_])operator(?:[^\p{L}\p{N}_]|$)"

# Conditional lines: the word and what follows it; the tokens of a condition, and the
# steps that evaluate one written with 0, 1, ! = ^ & | and parentheses (equality, difference,
# and, or as one character each): (pattern, groups before, value, groups behind).
DIRECTIVE_RE = r"^# *(if|elif|else|endif)([^\p{L}\p{N}_].*)?$"
CONDITION_TOKEN_RE = _ID + r"|&&|\|\||==|!=|[^ ]"
CONDITION_OPERATORS = {"&&": "&", "||": "|", "==": "=", "!=": "^"}
CONDITION_TEXTS = (("!0", "1"), ("!1", "0"), ("(0)", "0"), ("(1)", "1"), ("0=0", "1"), ("1=1", "1"), ("0=1", "0"), ("1=0", "0"),
                   ("0^0", "0"), ("1^1", "0"), ("0^1", "1"), ("1^0", "1"))
CONDITION_PAIRS = ((r"(^|[(&|])(?:0&[01]|1&0)($|[)&|])", "0"), (r"(^|[(&|])1&1($|[)&|])", "1"),
                   (r"(^|[(|])(?:1\|[01]|0\|1)($|[)|])", "1"), (r"(^|[(|])0\|0($|[)|])", "0"))

# Code tokenizer (features): newline, literals, identifiers, numbers,
# two-character operators, any other non-space character.
_CODE_TOKEN = "|".join(
    [
        r"\n",
        _VSTR,
        r'"(?:[^"\\\n]|\\[^\n])*P"',
        r"'(?:[^'\\\n]|\\[^\n])*P'",
        r"[\p{L}_][\p{L}\p{N}_]*",
        r"\p{N}+(?:\.\p{N}+)?",
        r"==|!=|<=|>=|&&|\|\||=>|\+\+|--|\+=|-=|\*=|/=|::|\?\?",
        r"[^ \p{L}\p{N}_]",
    ]
)
CODE_TOKEN_RE, CODE_TOKEN_RE2 = java(_CODE_TOKEN), re2(_CODE_TOKEN)

# Fixture text filter (keeps letters, digits, underscore, space, newline).
PROSE_KEEP_RE = r"[^\p{L}\p{N}_ \n]"
