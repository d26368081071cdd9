"""Operator 5: quality rules with tokenizer fertility.

Base rules count words, symbols, repeated lines and repeated 8-word windows. On
top, a public vocabulary with byte fallback measures each text: characters per
token, share of byte-fallback tokens, and entropy of the token distribution
relative to its maximum. The last is reported for the whole text, where it falls with
length; judged is its mean over windows of 64 tokens that cover the text (of 16 tokens in
texts shorter than 64), which has the same expectation for any length. Rejection bands are learnt for each language (for rows
without one, for each script): around the median of all documents that pass the
base rules, ``WIDTH`` times the spread between the quartiles on either side, and
never narrower than ``LEAST_WIDTH``. Bands are learnt from texts of at least
``MIN_TOKENS`` tokens; for a shorter text of n they are wider by the root of
``MIN_TOKENS`` / n, as its measures vary more. Only extreme texts fall outside, so plain
ones are kept.

The measures are one small row for each document, written once; the bands are
exact in what they cover (all documents) and approximate percentiles in value.

Defined cases: null and empty texts have no words, fail the base rules and are not
kept; very long texts are measured whole; repeated rows are judged alike; an
empty table gives no rows; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WIDTH = 5.0
LEAST_WIDTH = {"chars_per_token": 0.15, "byte_share": 0.1, "entropy_64": 0.05, "entropy_16": 0.05}
MIN_TOKENS = 100
#: A group's band counts as much as this many documents of the band behind it: that of
#: the script for a language; for a script, its own, as much wider as it has few.
SHRINK = 30
#: Bands beyond this number are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_BANDS = 100_000
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
            "chars_per_token double, byte_share double, entropy double, entropy_64 double, entropy_16 double, script string")


def repeated(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice."""
    w = C.windows(hashes, width)
    if len(w) < 2:
        return 0
    _, which, n = np.unique(w, return_inverse=True, return_counts=True)
    if len(n) == len(w):
        return 0
    twice = n[which] > 1
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[: len(w)] += twice
    edges[width : width + len(w)] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


#: First code points of runs of one script; "" where characters belong to none.
SCRIPTS = (
    (0x00, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"), (0x780, "thaana"), (0x7C0, "nko"),
    (0x800, "other"), (0x860, "syriac"), (0x870, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"),
    (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"),
    (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "canadian"), (0x1680, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1D00, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2DE0, "cyrillic"), (0x2E00, ""),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, ""), (0x31A0, "han"), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"),
    (0x4DC0, ""), (0x4E00, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xAC00, "hangul"), (0xD7FC, ""), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0xFF21, "latin"), (0xFF3B, ""),
    (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFDD, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "han"), (0x40000, ""),
)
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_NAMES = sorted({name for _, name in SCRIPTS} - {""})
_RUN = np.array([_NAMES.index(name) if name else len(_NAMES) for _, name in SCRIPTS])


def script_of(text: str) -> str:
    """Script of most letters. Japanese mixes two: ``kana`` where at least a tenth of
    its letters are. ``other`` stands for several rare scripts."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "none"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.bincount(_RUN[np.searchsorted(_STARTS, codes, "right") - 1], minlength=len(_NAMES) + 1)[:-1]
    kana, han = _NAMES.index("kana"), _NAMES.index("han")
    if 10 * counts[kana] >= counts[kana] + counts[han]:
        counts[kana] += counts[han]
        counts[han] = 0
    return _NAMES[int(counts.argmax())] if counts.any() else "none"


def window_entropy(ids: np.ndarray, width: int) -> float | None:
    """Mean entropy, relative to its maximum, of windows of ``width`` tokens: one after the
    other, and the last ``width`` tokens if some are left. None for a shorter text."""
    n = len(ids) // width
    if not n:
        return None
    rows = ids[: n * width].reshape(n, width)
    if n * width < len(ids):
        rows = np.vstack([rows, ids[-width:]])
    rows = np.sort(rows, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    times = np.diff(np.append(np.flatnonzero(new), rows.size)).astype(float)
    return float(1 - (times * np.log(times)).sum() / (rows.size * np.log(width)))


class Meter:
    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        self.words = C.WordIds(lambda words: model.encode([w.decode() for w in words], num_threads=1))
        self.hasher = C.WordHash()

    def measure(self, texts: list[str | None]) -> list[tuple]:
        split = [C.space_words(t) for t in texts]
        rows = []
        for text, words, ids in zip(texts, split, self.words.ids(split, []), strict=True):
            text = text or ""
            data = text.encode()
            chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
            lines = [line for line in data.split(b"\n") if line.strip()]
            n = len(ids)
            share = np.unique(ids, return_counts=True)[1] / max(n, 1)
            entropy = float(-(share * np.log(share)).sum() / np.log(n)) if n > 1 else 0.0
            rows.append((len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                         repeated(self.hasher.of(words)), n, chars / n if n else 0.0,
                         float(self.is_byte[ids].mean()) if n else 0.0, entropy,
                         window_entropy(ids, 64), window_entropy(ids, 16), script_of(text)))
        return rows


def meter(name: str = VOCABULARY):
    """Column function: struct of the measures of a text."""
    names = [c.split()[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Meter(name)
        for texts in batches:
            all_texts = texts.tolist()
            rows = [r for i in range(0, len(all_texts), 256) for r in m.measure(all_texts[i : i + 256])]
            yield pd.DataFrame(rows, columns=names)

    return measures.asNondeterministic()


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """A row for each group of ``band`` (languages) and for each of ``script``: middle and
    reach of each measure, from all documents of the group that pass the base rules."""
    judged = measured.filter(~F.col("base_failed") & (F.col("n_tokens") >= MIN_TOKENS))
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(m) for m in LEAST_WIDTH]
    groups = [judged.groupBy(F.col(g).alias("name")).agg(F.lit(g).alias("of"), F.count("*").alias("n"), *quartiles) for g in ("band", "script")]
    limits = []
    for m, least in LEAST_WIDTH.items():
        limits += [F.col(m)[1].alias(f"{m}_mid"), F.greatest(F.lit(least), WIDTH * (F.col(m)[2] - F.col(m)[0])).alias(f"{m}_reach")]
    return groups[0].unionByName(groups[1]).select("name", "of", "n", *limits)


def verdict(measured: DataFrame) -> DataFrame:
    """Adds ``in_band`` and ``kept``. A document is judged by its language's band, drawn
    towards that of its script by how few documents the language has; one of no group with
    a band by none. No count switches a rule on or off."""
    found = C.stored(bands(measured), "quality-bands")
    sides = [F.broadcast if found.count() <= MAX_BROADCAST_BANDS else (lambda x: x)] * 2
    names = ["n", *(c for c in found.columns if c not in ("name", "of", "n"))]
    own = found.filter("of = 'band'").select(F.col("name").alias("band"), *[F.col(c).alias(f"own_{c}") for c in names])
    rest = found.filter("of = 'script' and name not in ('none', 'other')").select(F.col("name").alias("script"), *[F.col(c).alias(f"script_{c}") for c in names])
    rows = measured.join(sides[0](own), "band", "left").join(sides[1](rest), "script", "left")
    share = F.col("own_n") / (F.col("own_n") + SHRINK)
    few = lambda n: 1 + SHRINK / F.col(n)

    def drawn(own_value: Column, script_value: Column, alone: Column) -> Column:
        both = F.coalesce(share, F.lit(0.0)) * F.coalesce(own_value, F.lit(0.0)) + (1 - F.coalesce(share, F.lit(0.0))) * script_value
        return F.coalesce(both, alone)

    wider = F.greatest(F.lit(1.0), F.sqrt(MIN_TOKENS / F.greatest(F.col("n_tokens"), F.lit(1))))
    ok = F.lit(True)
    for m in LEAST_WIDTH:
        own_reach, script_reach = F.col(f"own_{m}_reach"), F.col(f"script_{m}_reach") * few("script_n")
        mid = drawn(F.col(f"own_{m}_mid"), F.col(f"script_{m}_mid"), F.col(f"own_{m}_mid"))
        reach = drawn(own_reach, script_reach, own_reach * few("own_n"))
        low, high = mid - reach * wider, mid + reach * wider
        if m == "byte_share":
            inside = F.col(m) <= high
        elif m == "chars_per_token":
            inside = F.col(m).between(low, high)
        else:  # the wider window, where the text has one
            inside = (F.col(m) >= low) | ((F.col("n_tokens") >= 64) if m == "entropy_16" else F.lit(False))
        ok = ok & F.coalesce(inside, F.lit(True))
    rows = rows.withColumn("in_band", ok)
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop(*[f"{g}_{c}" for g in ("own", "script") for c in names])


def judge(docs: DataFrame, name: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """doc_id, the measures, base_failed, in_band, kept."""
    language = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("_id"), language.alias("_lang"), meter(name)(F.col(text)).alias("_m"))
    rows = rows.select("_id", F.coalesce(F.col("_lang"), F.concat(F.lit("script:"), "_m.script")).alias("band"), "_m.*")
    return verdict(C.stored(rows.withColumn("base_failed", base_failed()), "quality-measures")).withColumnRenamed("_id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "byte_share", "entropy")
