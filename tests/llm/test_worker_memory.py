"""What tasks keep and hand over: shared caches, equal results, small batches."""

import random

import numpy as np

from vulnscan.llm import quality_classifier as Q
from vulnscan.llm import token_count as T


def _merged(ranks, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_tasks_of_a_worker_share_the_counter():
    """op1: a counter a task learnt every word of its texts anew."""
    counter = T.compiled(T.VOCABULARY)
    texts = ["a few words, then some more", None, "", "naïve　text\n\n 12"]
    first = counter.counts(texts).tolist()
    assert T.compiled(T.VOCABULARY) is counter and counter.words
    assert counter.counts(texts).tolist() == first == T.TokenCounter().counts(texts).tolist()


def test_merging_takes_the_lowest_rank_first():
    merges = T.compiled(T.VOCABULARY).words.transducer
    rng, tokens = random.Random(3), sorted(merges.tokens)
    for _ in range(3000):
        left, right = rng.choice(tokens), rng.choice(tokens)
        expected = _merged(merges.ranks, left + right)
        assert merges.encode(left + right) == expected
        assert merges.compatible(left, right) == (expected == [left, right])


def test_sums_are_handed_over_in_parts():
    """pipeline: one batch of all slots held 35 MB on either side of a task's pipe."""
    sums = np.arange(3 * (2 * Q.HANDED + 5)).reshape(-1, 3)
    used = np.arange(1, len(sums))
    batches = list(Q._rows(used, sums, ["a", "b", "c"]))
    assert [b.num_rows for b in batches] == [Q.HANDED, Q.HANDED, 4]
    assert np.concatenate([b.column(0) for b in batches]).tolist() == used.tolist()
    assert np.concatenate([b.column(2) for b in batches]).tolist() == sums[used, 1].tolist()
    assert [b.num_rows for b in Q._rows(used[:0], sums, ["a", "b", "c"])] == [0]


def test_index_vectors_take_a_byte_an_entry():
    """pipeline: the places of all rows were drawn at once, eight bytes an entry."""
    rows = Q.HANDED + 3
    rng = np.random.default_rng(6)
    places = rng.random((rows, Q.DIMENSIONS), np.float32).argpartition(4, axis=1)[:, :4]
    expected = np.zeros((rows, Q.DIMENSIONS), np.int64)
    np.put_along_axis(expected, places, rng.choice([-1, 1], (rows, 4)), axis=1)
    got = Q.index_vectors(rows)
    assert got.dtype == np.int8 and (got == expected).all()
