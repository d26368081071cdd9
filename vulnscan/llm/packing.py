"""Operator 2: hierarchical packing into sequences of several lengths.

Each task packs the documents it reads, in pools of a bounded number of tokens:

* Whole windows of the longest context are cut from long documents.
* What is left of a document is routed to the tier of the smallest context size
  that holds it (512, 1024, 2048, 4096).
* Tiers are packed from long to short. A window takes the longest fragments of its
  tier that fit; its gap is filled from the shorter tiers, best fit first, and the
  last bit by cutting a short fragment. So windows are full, and a full window of
  any tier is a power of two long and needs no padding.
* What is left at the end of a pool goes into the next; at the end of the task it is
  cut into windows of falling powers of two.
* Sequences are dealt into step groups of ``GROUP_TOKENS``: a group has sequences of
  one tier, hence the same shape and cost; the sequences left over in a tier at the
  end of the task share mixed groups.

No shuffle: any split of the input packs equally well, a task's loss is nil.

Defined cases: null or empty text is a document of the end id alone; repeated rows
are packed each; a document longer than a pool is cut as it comes; null ids are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "word_bpe_49k.json"
CONTEXT = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
POOL_TOKENS = 1 << 19
GROUP_TOKENS = 1 << 16
#: Words, and words of letters alone, that a task's encoder remembers: fewer take less
#: memory and more time, and give the same ids.
CACHED_WORDS = 400_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "context int, step_group long")


#: Letters (a-z and the Latin-1 ones, which normalisation leaves apart from their case),
#: and marks after them, at which the tokenizer always splits.
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?%$&#*|]*)")
#: One such mark between a letter and white space is a word of its own, so that a word is
#: learnt once and not with every mark behind it.
_MARK = r"([a-z])([.,;:!?%$&#*|])([ \t\n\v\f\r])"


class Encoder:
    """Ids of whole texts. The tokenizer splits at white space before anything else
    acts across it, so texts are looked up word by word, and each word is encoded
    once: words of letters together in one call, where the end-of-word tokens tell
    them apart, the marks after them and all other words one by one."""

    def __init__(self, name: str = VOCABULARY, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters: dict[bytes, list[int]] = {}
        self.cached_words = cached_words
        self.words = C.WordIds(self._encode, cached_words)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        found = [_WORD.fullmatch(w) for w in words]
        if len(self.letters) > self.cached_words:
            self.letters.clear()
        known = self.letters  # words of letters alone, which stand with many marks behind them
        letters = list({m[1] for m in found if m}.difference(known))
        flat = np.array(self._ids([b" ".join(letters)])[0], np.int64)
        ends = (np.flatnonzero(self.is_end[flat]) + 1).tolist()
        assert len(ends) == len(letters)
        flat = flat.tolist()
        known.update(zip(letters, (flat[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        rest = list({m[2] for m in found if m and m[2]} | {w for w, m in zip(words, found, strict=True) if not m})
        alone = dict(zip(rest, self._ids(rest), strict=True))
        return [alone[w] if not m else known[m[1]] + alone[m[2]] if m[2] else known[m[1]] for w, m in zip(words, found, strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        texts = pc.fill_null(texts, "")
        # the tokenizer ignores case, but for its special tokens
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, "", pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        out = self.words.by_code(*C.word_codes(pc.replace_substring_regex(plain, _MARK, r"\1 \2\3")), END_ID)
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.words.ids([texts[i].as_py().encode().split()], [END_ID])[0]
        return out


class Packer:
    """Packs the fragments of one task. Fragments are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, base: int, context: int = CONTEXT, tiers=TIERS, pool_tokens: int = POOL_TOKENS, group_tokens: int = GROUP_TOKENS):
        assert context == tiers[-1]
        self.base, self.context, self.tiers = base, context, tiers
        self.pool_tokens, self.group_tokens = pool_tokens, group_tokens
        self.pool: list[list] = [[] for _ in tiers]  # by tier: sorted (length, serial, fragment)
        self.pooled = self.serial = self.sequences = self.groups = 0
        self.open_groups: dict[int, tuple[int, int]] = {}  # context -> (group, tokens)
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.context:
            self._emit([(doc_id, at, ids[at : at + self.context], n)])
            at += self.context
        if at < n:
            self._keep((doc_id, at, ids[at:], n))
        if self.pooled >= self.pool_tokens:
            self.pack()

    def _keep(self, fragment) -> None:
        size = len(fragment[2])
        self.serial += 1
        insort(self.pool[bisect_right(self.tiers, size - 1)], (size, self.serial, fragment), key=lambda x: x[:2])
        self.pooled += size

    def _take(self, tier: int, i: int):
        size, _, fragment = self.pool[tier].pop(i)
        self.pooled -= size
        return fragment

    def _fitting(self, gap: int, highest: int):
        """The longest fragment of the tiers up to ``highest`` that fits the gap."""
        for tier in range(highest, -1, -1):
            i = bisect_right(self.pool[tier], gap, key=lambda x: x[0]) - 1
            if i >= 0:
                return self._take(tier, i)
        return None

    def _window(self, size: int, tier: int):
        """Fragments that fill a window, or None if the pool has too few tokens."""
        held = sum(x[0] for t in range(tier + 1) for x in self.pool[t]) if self.pooled < 4 * size else size
        if held < size:
            return None
        parts, gap = [], size
        while gap:
            fragment = self._fitting(gap, tier)
            if fragment is None:  # all are longer: cut the shortest
                fragment = self._take(next(t for t in range(tier + 1) if self.pool[t]), 0)
                doc_id, start, ids, n = fragment
                self._keep((doc_id, start + gap, ids[gap:], n))
                fragment = (doc_id, start, ids[:gap], n)
            parts.append(fragment)
            gap -= len(fragment[2])
        return parts

    def pack(self) -> None:
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pool[tier]:
                parts = self._window(self.tiers[tier], tier)
                if parts is None:
                    break
                self._emit(parts)

    def close(self) -> None:
        """Packs all that is left; windows of falling powers of two."""
        self.pack()
        size = self.context
        top = len(self.tiers) - 1
        while size:
            while self.pooled >= size:
                self._emit(self._window(size, top))
            size //= 2

    def _emit(self, parts) -> None:
        length = sum(len(p[2]) for p in parts)
        group, tokens = self.open_groups.get(length if length in self.tiers else 0, (None, 0))
        if group is None or tokens + length > self.group_tokens:
            group, tokens = self.base + self.groups, 0
            self.groups += 1
        self.open_groups[length if length in self.tiers else 0] = (group, tokens + length)
        offset = 0
        for doc_id, start, ids, n in parts:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, n, self.base + self.sequences, offset, length, group))
            offset += len(ids)
        self.sequences += 1

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, name: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", pool_tokens: int = POOL_TOKENS,
         cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row for each piece; ``context`` is its sequence's length and ``step_group`` its group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(name, cached_words), Packer(TaskContext.get().partitionId() << 33, pool_tokens=pool_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    packer.add(key, ids)
                if len(packer.rows) >= 4096:
                    yield _batch(packer.drain())
        packer.close()
        yield _batch(packer.drain())

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(lambda batches: C.trimmed(run(batches)), SCHEMA)


_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
_NAMES = [c.split()[0] for c in SCHEMA.split(",")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))
