"""Small tables with the awkward rows that every operator must stand."""

import random

import pytest
from samples import edited, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size string, copies string"


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text) pairs: copies, near copies, nulls, empties, long texts, repeated rows and ids."""
    chance = random.Random(5)
    texts = [prose(chance, chance.randrange(20, 160)) for _ in range(40)]
    rows = list(enumerate(texts))
    rows += [(100 + k, texts[k]) for k in range(6)]
    rows += [(200 + k, edited(chance, texts[k % 8], 0.02)) for k in range(24)]
    rows += [(300 + k, edited(chance, texts[3], 0.05)) for k in range(12)]
    shared = prose(chance, 60, 60)
    rows += [(400 + k, shared + "\n" + prose(chance, 70)) for k in range(12)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "one two"), (505, "Ünï ß 名前"), (506, "!!! ..."), (507, "a b c d e")]
    rows += [(510, prose(chance, 20_000)), (511, "x" * 50_000), (512, ("again and again " * 400))]
    rows += [(None, texts[0]), (None, prose(chance, 40)), (None, None), (7, texts[7]), (7, texts[7]), (8, prose(chance, 30))]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names clash with result columns."""

    def make(rows, lang=lambda i: "en", source=lambda i: None if i is None else f"s{i % 4}"):
        full = [(i, t, lang(i), source(i), len(t) if t else 0, 0.5, "no", "big", "many") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(frame, awkward_rows):
    return frame(awkward_rows)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
