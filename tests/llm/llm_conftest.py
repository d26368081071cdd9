import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "the of and river stone morning light cold paper window quiet road winter garden music letter bridge summer harbor silver".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices(("an", "re", "sto", "li", "ver", "ma", "ting", "o"), k=rng.randint(1, 4))) for _ in range(n))


def edge_rows():
    """Ids and texts: nulls, empty, white space, short, ties, copies, near copies, long."""
    base = prose(1, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    far = base[:60] + prose(2, 60).split()
    return [
        (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "One"), (5, "one two three"), (6, "one two three four five"),
        (7, " ".join(base)), (8, " ".join(base)), (9, " ".join(near)), (10, " ".join(far)), (11, "\n".join(base).upper()),
        (12, " ".join(base) + " " + prose(3, 20)), (None, " ".join(base)), (None, None), (13, "tail"), (13, "tail"),
        (14, prose(4, 30_000)), (15, "x" * 100_000), (16, "a" + "é" * 40 + " ß İ 日本語 😀 \u2028 \u00a0 e\u0301"), (17, "same line\nsame line\n\nsame line\n" + prose(5, 30)),
        (18, "### ** $%& | <> " * 9), (19, "\x00\x1c\x85 odd\x7fwords 'll they're 's"),
        (20, "mail a.b+c@x-y.example.org, a@b.c_d@e.fg 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8, 4111 1111 1111 1111 +1 (555) 123-4567 +12 34"),
        (21, 'token = "0123456789abcdef0123456789abcdef01234567" and more'), (22, "under the MIT License. Under the mit license, CC BY-NC 4.0"),
        (23, "Licensed under the Apache License, Version 2.0 and the GNU General Public License, version 3."), (24, "<|endoftext|>a<|endoftext|> <|startoftext|>"),
    ]


CLASHING = "n_tokens size shard score spans labels node comp n s text_crc32 kept _text _w _h _row band row h".split()


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(*r, "en", "src", 0, *["clash"] * len(CLASHING)) for r in edge_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    from vulnscan.session import share_package

    share_package(spark)


def collected(df, *cols):
    """Rows as sorted tuples, nulls last."""
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)
