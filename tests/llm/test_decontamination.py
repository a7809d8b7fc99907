"""Decontamination against a search by words."""

import hashlib
import random
import re

from wardline.llm import decontamination

from samples import prose


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    words, hit, ids = words_of(text), set(), set()
    for item_id, item in items:
        known = words_of(item)
        size = min(10, len(known))
        windows = {tuple(known[k : k + size]) for k in range(len(known) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                ids |= {str(item_id)} if item_id is not None else set()
    ids = sorted(ids)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def case(awkward_rows):
    chance = random.Random(6)
    long, other = prose(chance, 40), prose(chance, 12)
    items = [(1, long), (2, other), (3, "Three Ünique words"), (4, None), (5, "... !"), (6, long[:200]), (None, prose(chance, 11)), (2, "a second text of item two that has more than ten words in it"), (10, long), (1, long)]
    texts = [
        f"before {long} after", f"x {other.upper().replace(' ', '--', 3)} y", "three ünique words", "THREE. ünique, words three ünique", " ".join(long.split()[5:14]),
        " ".join(long.split()[5:15]), f"{other} {long} {other}", items[6][1], "words three ünique",
    ]
    return items, [*awkward_rows, *[(1000 + k, t) for k, t in enumerate(texts)]]


def test_against_brute_force(spark, frame, awkward_rows):
    items, rows = case(awkward_rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = sorted(repr((i, *brute(t, items))) for i, t in rows)
    for block_bytes in (decontamination.BLOCK_BYTES, 200):
        got = decontamination.contamination(frame(rows), benchmark, block_bytes=block_bytes)
        assert sorted(repr(tuple(r)) for r in got.collect()) == wanted


def test_documents_and_spans(spark, frame, awkward_rows):
    items, rows = case(awkward_rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted(repr((i, t)) for i, t in rows if not brute(t, items)[1])
    kept = decontamination.drop_contaminated(frame(rows), benchmark)
    assert kept.columns == frame(rows).columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == clean
    cut = decontamination.cut_spans(frame(rows), benchmark, block_bytes=200).collect()
    assert len(cut) == len(rows) and not any(brute(r["text"], items)[1] for r in cut)
    assert {r["text"] for r in cut if r["doc_id"] == 1000} == {"before \n after"}


def test_empty_tables(spark, nothing, awkward, awkward_rows):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(nothing, benchmark).collect() == []
    assert not any(r["contaminated"] for r in decontamination.contamination(awkward, benchmark).collect())
