"""One document of each group stays, also where ids are missing or shared."""

import random

from wardline.llm import lines, minhash

from samples import edited, prose


def test_one_document_of_each_group(frame):
    chance = random.Random(31)
    a, b, c = (" ".join(prose(chance, 150).split()) for _ in range(3))
    rows = [(None, a), (None, a), (None, edited(chance, a, 0.01)), (5, b), (5, edited(chance, b, 0.01)), (None, b), (None, c), (6, "")]
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one_of_each(frame(rows)).select("doc_id", "text").collect()]
    assert len(kept) == 4 and (None, c) in kept and (6, "") in kept and sum(i == 5 for i, _ in kept) == 1
    assert sum(i is None for i, _ in kept) == 2


def test_first_line_of_rows_without_id(frame):
    line = "a line that is long enough to count as one"
    rows = [(None, line), (None, line), (3, "other words entirely\nshared by two texts of one id"), (3, "something else again\nshared by two texts of one id")]
    left = sorted(r["text"] for r in lines.without_lines(frame(rows)).collect())
    assert left.count(line) == 1 and sum("shared by two" in t for t in left) == 1 and len(left) == 3
