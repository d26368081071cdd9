"""Plain-Python models of the behaviour being reproduced, written from the
"""

from __future__ import annotations

# Python str.strip() whitespace set (used for the independent check of WS).
PY_WS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

SEPARATORS = ("Ċ", " Ċ", "ĊĊ", " ĊĊ")


def strip_comments(s: str) -> str:
    """Left-to-right scan: ``/*`` up to the first following ``*/`` (kept if
    unterminated), ``//`` up to the next newline (newline kept)."""
    out, i, n = [], 0, len(s)
    while i < n:
        if s.startswith("/*", i):
            j = s.find("*/", i + 2)
            if j >= 0:
                i = j + 2
                continue
        if s.startswith("//", i):
            j = s.find("\n", i)
            i = n if j < 0 else j
            continue
        out.append(s[i])
        i += 1
    return "".join(out)


def clean_lines(s: str) -> list[str]:
    """A line is a maximal run of characters without a line break; carriage returns and
    tabs do not count, and neither does white space at a line's ends."""
    lines, current = [], []
    for ch in strip_comments(s) + "\n":
        if ch == "\n":
            solid = [i for i, c in enumerate(current) if c not in PY_WS]
            if solid:
                lines.append("".join(current[solid[0] : solid[-1] + 1]))
            current = []
        elif ch not in "\r\t":
            current.append(ch)
    return lines


def clean_single_line(s: str) -> str:
    return " ".join(clean_lines(s))


def clean_multi_line(s: str) -> str:
    return "\n".join(clean_lines(s))


def add_line_delimiters(s: str) -> str:
    return s.replace(";", ";\n").replace("{", "\n{\n").replace("}", "}\n")


def mask_special(scores: list, padding: bool = True) -> list:
    """Two positions are zero: the first, and the end marker. The end marker is the last
    position, or with padding the greatest one after the first with a score."""
    end = len(scores) - 1
    if padding:
        end = max((i for i, x in enumerate(scores) if i > 0 and x != 0), default=0)
    return [0 if i in (0, end) else x for i, x in enumerate(scores)]


def line_scores(tokens: list[str], scores: list) -> list:
    """Cut the sequence behind every separator and behind its last token. The scores
    before a part's closing token decide whether it counts as a line; what is open
    when it does not (a part whose content sums to 0 and whose closing token is a
    separator leaves nothing behind) is not carried on. A line's value includes its
    closing token."""
    cuts = [i + 1 for i, t in enumerate(tokens) if t in SEPARATORS or i == len(tokens) - 1]
    parts = [range(a, b) for a, b in zip([0, *cuts], cuts)]
    content = [sum(scores[i] for i in part[:-1]) for part in parts]
    return [c + scores[part[-1]] for c, part in zip(content, parts) if c != 0]


def rank_lines(line_vals: list) -> list[int]:
    """Indices by score descending; a stable sort keeps ties in index order."""
    return sorted(range(len(line_vals)), key=lambda i: -line_vals[i])


def confusion(labels: list[int], preds: list[int]) -> tuple[int, int, int, int]:
    tn = sum(1 for a, b in zip(labels, preds) if a == 0 and b == 0)
    fp = sum(1 for a, b in zip(labels, preds) if a == 0 and b == 1)
    fn = sum(1 for a, b in zip(labels, preds) if a == 1 and b == 0)
    tp = sum(1 for a, b in zip(labels, preds) if a == 1 and b == 1)
    return tn, fp, fn, tp


def prf(tn, fp, fn, tp):
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    f = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    return p, r, f
