"""Helpers shared by the training-data operators: reading, scratch tables, words.

Words are handled as UTF-8 bytes inside tasks: ``bytes.translate`` and
``bytes.split`` run in C, and a code point at or above U+0080 only has bytes at
or above 0x80, so byte-wise classes give the same words as the code-point
classes of the contracts.
"""

from __future__ import annotations

import ctypes
import gc
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, read_table, scratch_path

__all__ = ["checkpoint_root", "read_table", "scratch_path", "documents", "stored", "UPPER", "LOWER"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_FOLD = {ord(u): ord(low) for u, low in zip(UPPER, LOWER, strict=True)}
#: A-Z to a-z, every other byte as it is.
FOLD_TABLE = bytes(_FOLD.get(b, b) for b in range(256))


def _alnum_byte(b: int) -> int:
    b = _FOLD.get(b, b)
    return b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20


#: As FOLD_TABLE, with every ASCII byte that is no digit or letter as a space.
ALNUM_TABLE = bytes(_alnum_byte(b) for b in range(256))

#: Java class of the bytes that separate alphanumeric words (after folding).
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read
    back: later steps reread files that every executor sees."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(text) -> "F.Column":
    """A-Z lower-cased, nothing else; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased alphanumeric words (see ``ALNUM_SEPARATORS``); null has none."""
    return text.encode().translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D); null has none."""
    return text.encode().split() if text else []


def word_codes(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All words between ASCII white space of a column of texts: the place of each word in
    the list of distinct ones, that list, and the number of words of each text. So a
    batch looks each distinct word up once."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = lists.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    distinct = found.dictionary.cast(pa.binary()).to_pylist()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in distinct:  # white space at either end leaves an empty word
        keep = codes != distinct.index(b"")
        of = np.repeat(np.arange(len(sizes)), sizes)
        codes, sizes = codes[keep], np.bincount(of[keep], minlength=len(sizes))
    return codes, distinct, sizes


class WordHash(dict):
    """64-bit hashes of words. A cache of bounded size, safe to lose."""

    def __init__(self, seed: int = 0, limit: int = 100_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _MIX + hashes[k : k + n]
    return mix(out)


def trim() -> None:
    """Hands freed memory back to the system. Python workers live on between tasks, and
    what they hold counts against the executor. Arrow's buffers lie in a pool of their own."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if release is not None:
        release(0)


def trimmed(batches):
    """The batches of a task's generator, and a ``trim`` when it has ended."""
    yield from batches
    gc.collect()
    trim()


class WordIds:
    """Ids of whole texts by words: each word is encoded once by ``encode_many`` and its
    ids are kept in one flat array. Bounded; dropped and refilled when full."""

    def __init__(self, encode_many, limit: int = 400_000):
        self.encode_many, self.limit = encode_many, limit
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        got = self.encode_many(words)
        n = np.fromiter(map(len, got), np.int64, len(got))
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))
        self.first = np.concatenate([self.first, self.used + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.used += total

    def ids(self, texts: list[list[bytes]], end: list[int]) -> list[np.ndarray]:
        """The ids of each list of words, followed by ``end``."""
        every = set().union(*texts)
        new = every.difference(self.places)
        if len(self.places) + len(new) > self.limit and self.places:
            self._clear()
            new = every
        if new:
            self._learn(list(new))
        out = []
        for words in texts:
            at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            n = self.count[at]
            total = int(n.sum())
            made = np.empty(total + len(end), np.uint32)
            # the k-th id of a word lies k places after the word's first
            made[:total] = self.flat[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(total)]
            made[total:] = end
            out.append(made)
        return out

    def by_code(self, codes: np.ndarray, distinct: list[bytes], sizes: np.ndarray, end: int) -> list[np.ndarray]:
        """As ``ids``, for the words of ``word_codes``."""
        new = [w for w in distinct if w not in self.places]
        if len(self.places) + len(new) > self.limit and self.places:
            self._clear()
            new = distinct
        if new:
            self._learn(new)
        at = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[codes]
        n = self.count[at]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        # ids of a text end where those of its last word end, and one place later for each text before
        bounds = np.concatenate([[0], upto])[np.cumsum(sizes)]
        made = np.empty(total + len(sizes), np.uint32)
        ends = bounds + np.arange(len(sizes))
        made[ends] = end
        own = np.ones(len(made), bool)
        own[ends] = False
        made[own] = self.flat[np.repeat(self.first[at] - (upto - n), n) + np.arange(total)]
        return np.split(made, ends[:-1] + 1) if len(ends) else []
