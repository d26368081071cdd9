"""Operator 1: token counts by finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

*Split transducer.* 16 states over 11 character classes find the tokenizer's
pre-tokens. A transition says whether the character before it starts a
pre-token (one character of delay settles white space and contractions). Texts
are cut into chunks of ``CHUNK`` characters; every chunk is run from all states
at once, which gives its state map; the maps compose associatively, and a
parallel prefix scan over them yields the true entry state of each chunk, from
which all chunks emit their boundaries in lockstep.

*Merge transducer.* Reads the bytes of a pre-token; each transition carries the
change of the number of tokens that the bytes so far encode to. In BPE the
encoding of a prefix ends in exactly one token that is compatible with the token
before it (two tokens are compatible if their bytes together encode to just
them). So the state is the longest suffix that can still grow into a token, with
the last token and the relative count at each of its positions. States are made
when first reached and shared by all words that lead to them.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings in
a text count as their one token, as the library's default has it; very long
texts are processed whole, in stretches cut where a pre-token must start; the
caches are bounded and may be dropped at any time; repeated rows are counted
each; an empty table gives no rows; other columns are ignored by ``count_tokens``
and kept by callers of ``counter``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 512
#: Characters of a chunk that are run from all states before looking whether these have met.
SETTLING = 32
#: Characters that are worked on at a time.
STRETCH = 1 << 20
MAX_STATES = 300_000
MAX_WORDS = 600_000

#: Character classes. ``END`` closes a text, ``PAD`` changes nothing.
LETTER, S, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, END, PAD = range(13)
LETTERS = (LETTER, S, R, V, L, E)
#: States: what the last character is, and whether it starts a pre-token (``_1``), does
#: not (``_0``), or is not settled yet (the rest but START, QUOTED and DONE).
STATES = ("START", "LETTER_0", "LETTER_1", "NUMBER_0", "NUMBER_1", "OTHER_0", "OTHER_1", "QUOTED",
          "QUOTED_R", "QUOTED_V", "QUOTED_L", "DONE", "SPACE_1", "SPACES", "BLANK_1", "BLANKS")
_ID = {s: i for i, s in enumerate(STATES)}


def _settled(state: str, c: int) -> bool:
    """Whether the character that led to ``state`` starts a pre-token, given the next one's class."""
    if state in ("SPACES", "BLANKS"):  # the last blank of a run belongs to what follows, if anything does
        return c not in (SPACE, BLANK, END)
    if state in ("QUOTED_R", "QUOTED_V"):
        return c != E
    if state == "QUOTED_L":
        return c != L
    return state == "QUOTED" or state.endswith("_1")


def _next(state: str, c: int) -> str:
    kind = state.partition("_")[0]
    if c == END:
        return "START"
    if c in (SPACE, BLANK):
        longer = kind in ("SPACE", "SPACES", "BLANK", "BLANKS")
        return ("SPACES" if longer else "SPACE_1") if c == SPACE else ("BLANKS" if longer else "BLANK_1")
    joined = kind in ("SPACE", "SPACES")  # a single space goes with what follows it
    if c in LETTERS:
        if state == "QUOTED":
            return {S: "DONE", R: "QUOTED_R", V: "QUOTED_V", L: "QUOTED_L"}.get(c, "LETTER_1")
        if state.startswith("QUOTED_"):
            return "LETTER_0" if _settled(state, c) else "DONE"
        return "LETTER_0" if joined or kind == "LETTER" else "LETTER_1"
    if c == NUMBER:
        return "NUMBER_0" if joined or kind == "NUMBER" else "NUMBER_1"
    if joined or kind == "OTHER" or state == "QUOTED":
        return "OTHER_0"
    return "QUOTED" if c == QUOTE else "OTHER_1"


def split_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted start, by state * 13 + class."""
    move, emit = np.zeros((len(STATES), 13), np.uint8), np.zeros((len(STATES), 13), bool)
    for state, i in _ID.items():
        for c in range(13):
            move[i, c] = i if c == PAD else _ID[_next(state, c)]
            emit[i, c] = c != PAD and _settled(state, c)
    return move.ravel(), emit.ravel()


def class_table() -> np.ndarray:
    """Class of every code point, by the Unicode categories that the split pattern names."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, chars):
            shift = 0x800 if m.start() >= 0xD800 else 0
            table[m.start() + shift : m.end() + (0x800 if m.end() > 0xD800 else 0)] = c
    table[0xD800:0xE000] = OTHER
    for c, k in ((" ", SPACE), ("'", QUOTE), ("s", S), ("t", S), ("m", S), ("d", S), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(c)] = k
    return table


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, ``maps[i][s]`` being the state in
    which chunk i ends when entered in s: log2(n) doubling steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


class SplitTransducer:
    def __init__(self):
        self.move, self.emit = split_tables()
        self.classes = class_table()

    def starts(self, classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Whether each character starts a pre-token; texts are closed by END."""
        n = len(classes)
        chunks = -(-n // chunk)
        grid = np.full(chunks * chunk, PAD, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, chunk).T).astype(np.intp)
        maps = np.tile(np.arange(len(STATES), dtype=np.uint8), (chunks, 1))
        for column in grid[:SETTLING]:
            maps = self.move[maps * np.intp(13) + column[:, None]]
        # in most chunks all entry states have met by now, and one of them stands for all
        met = (maps == maps[:, :1]).all(axis=1)
        one, several = maps[met, 0], maps[~met]
        for column in grid[SETTLING:]:
            one = self.move[one * np.intp(13) + column[met]]
            if len(several):
                several = self.move[several * np.intp(13) + column[~met, None]]
        maps[met], maps[~met] = one[:, None], several
        state = np.zeros(chunks, np.uint8)
        state[1:] = compose_scan(maps)[:-1, _ID["START"]]
        out = np.empty((chunk, chunks), bool)
        for i, column in enumerate(grid):
            at = state * np.intp(13) + column
            out[i], state = self.emit[at], self.move[at]
        settled = out.T.ravel()[:n]
        return np.append(settled[1:], False)  # a transition settles the character before it


class MergeTransducer:
    """Token count of a pre-token's bytes."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        made = {a + b for a, b in merges}
        self.tokens = {t for t in vocabulary if len(t) == 1 or t in made}
        #: What a longer token starts with: only there can a later token begin.
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.moves: dict[int, tuple[int, int]] = {}
        # a state: the suffix, and for each of its positions where a later token can begin
        # the last token before it and the count there
        start = (b"", ((None, 0),))
        self.states, self.ids = [start], {start: 0}

    def encode(self, word: bytes) -> list[bytes]:
        """Plain merging of a short string, lowest rank first, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank_of, none = self.ranks.get, len(self.ranks)
        ranks = [rank_of(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), none)
        return parts

    def compatible(self, left: bytes | None, right: bytes) -> bool:
        if left is None:
            return self.encodes(right)
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MAX_STATES:
                self.fits.clear()
            # a pair that merges is never left as two
            known = self.fits[left, right] = (left, right) not in self.ranks and self.encode(left + right) == [left, right]
        return known

    def encodes(self, token: bytes) -> bool:
        known = self.fits.get((b"", token))
        if known is None:
            known = self.fits[b"", token] = self.encode(token) == [token]
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.states[state]
        suffix += bytes((byte,))
        for k, place in enumerate(places):
            token = suffix[k:]
            if place and token in self.tokens and self.compatible(place[0], token):
                break
        else:
            raise ValueError("no token ends here")
        change = place[1] + 1
        prefixes = self.prefixes
        while suffix not in prefixes:
            suffix, places = suffix[1:], places[1:]
        places = (*((p[0], p[1] - change) if p and suffix[i:] in prefixes else None for i, p in enumerate(places)), (token, 0))
        made = (suffix, places)
        if made not in self.ids:
            self.ids[made] = len(self.states)
            self.states.append(made)
        self.moves[state << 8 | byte] = move = (self.ids[made], change)
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in word:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            total += move[1]
        return total


class _Words(dict):
    """Counts of words seen, dropped when too many."""

    def __init__(self, transducer: MergeTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: bytes) -> int:
        n = self.transducer.count(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Compiled from a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_of_char()
        raw = lambda token: bytes(back[c] for c in token)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.words = _Words(MergeTransducer({raw(t): i for t, i in spec["model"]["vocab"].items()},
                                            [(raw(a), raw(b)) for a, b in merges]))
        self.split = SplitTransducer()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = self.special.split(text) if self.special else [text]
            out[i] += len(pieces) - 1
            for piece in pieces:
                for part in stretches(piece):
                    parts.append(part)
                    owners.append(i)
                    size += len(part)
                    if size >= STRETCH:
                        self._add(parts, owners, out)
                        parts, owners, size = [], [], 0
        if parts:
            self._add(parts, owners, out)
        return out

    def _add(self, parts: list[str], owners: list[int], out: np.ndarray) -> None:
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in parts]
        ends = np.cumsum([len(p) + 1 for p in points]) - 1  # places of the END marks
        every = np.zeros(ends[-1] + 1, np.uint32)
        inside = np.ones(len(every), bool)
        inside[ends] = False
        every[inside] = np.concatenate(points)
        classes = self.split.classes[every]
        classes[ends] = END
        starts = self.split.starts(classes) & inside
        data = "".join(parts).encode()
        at = np.flatnonzero(starts)
        cuts = at - np.searchsorted(ends, at)  # characters before, without the END marks
        if len(data) > int(inside.sum()):  # bytes beyond the first of each character
            more = (every >= 0x80).astype(np.uint8)
            more += every >= 0x800
            more += every >= 0x10000
            cuts += np.cumsum(more, dtype=np.int64)[at] - more[at]
        cuts = cuts.tolist()
        cuts.append(len(data))
        words = self.words
        n = np.fromiter(map(words.__getitem__, map(data.__getitem__, map(slice, cuts, cuts[1:]))), np.int64, len(cuts) - 1)
        owner = np.asarray(owners)[np.searchsorted(ends, at)]
        out += np.bincount(owner, weights=n, minlength=len(out)).astype(np.int64)


def stretches(text: str) -> Iterator[str]:
    """Cuts a long text before white space that follows other text: a pre-token starts
    there whatever comes before."""
    at = 0
    while len(text) - at > STRETCH:
        m = _CUT.search(text, at + STRETCH)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_CUT = re.compile(r"(?<=[0-9A-Za-z])[ \n]")


@lru_cache(1)
def compiled(name: str) -> TokenCounter:
    """The counter of a worker process: its tasks share what they have learnt, within the
    bounds of its caches."""
    return TokenCounter(name)


def counter(name: str = VOCABULARY):
    """Column function: number of tokens of a text."""
    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = compiled(name)
        for texts in batches:
            yield pd.Series(count.counts(texts.tolist()))

    return n_tokens.asNondeterministic()


def count_tokens(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body: Column = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(doc_id, F.octet_length(body).cast("long").alias("n_bytes"), counter(name)(body).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(C.documents(spark, sf_dir))
