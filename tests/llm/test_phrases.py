"""Phrase fingerprints against a parser over strings and exact Jaccard similarity, neighbours against a sorted list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from samples import edited, prose

from wardline.llm import phrases
from wardline.llm.phrases import edited_neighbours, fingerprint_documents, likeness, likeness_of, text_signature


def phrase_set(text):
    data, found, open_phrase = text.encode(), set(), b""
    for k in range(len(data)):
        open_phrase += data[k : k + 1]
        if open_phrase not in found:
            found.add(open_phrase)
            open_phrase = b""
    return found


def jaccard(a, b):
    a, b = phrase_set(a), phrase_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def neighbours(rows):
    """(doc_id, text, edited text, next text) in the order of the operator, for ids that do not repeat."""
    listed = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(listed):
        t, follower = t or "", listed[(k + 1) % len(listed)][1] or ""
        third = len(t) // 3
        yield i, t, t[: len(t) - third] + follower[:third], follower


def check(found, rows, size=phrases.SIZE):
    wanted = {i: (len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, n) for i, t, e, n in neighbours(rows)}
    assert len(found) == len(rows)
    for r in found:
        chars, digest, text, other, follower = wanted[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (chars, digest)
        sigs = [text_signature(x, size) for x in (text, other, follower)]
        assert r["fingerprint"] == sigs[0].astype(">u4").tobytes().hex() and r["edited_fingerprint"] == sigs[1].astype(">u4").tobytes().hex()
        assert r["near_edited"] == likeness(sigs[0], sigs[1], size) and r["near_next"] == likeness(sigs[0], sigs[2], size)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_neighbours_over_any_number_of_tasks(spark, frame, tasks):
    chance = random.Random(3)
    rows = [(i * 37 % 211, prose(chance, chance.randrange(0, 90)) if i % 9 else None) for i in range(60)] + [(None, "é名 " * 50), (900, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = edited_neighbours(frame(rows).repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    check(found, rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


@pytest.mark.parametrize("rows", [[(1, "one two three")], [(1, None)], [(2, "abc"), (1, "abd")], []])
def test_few_rows(frame, rows):
    check(edited_neighbours(frame(rows)).collect(), rows)


def test_awkward_rows(awkward, awkward_rows):
    found = edited_neighbours(awkward).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(repr(i) for i, _ in awkward_rows)
    lengths = sorted(len(t or "") for _, t in awkward_rows)
    assert sorted(r["n_chars"] for r in found) == lengths
    again = edited_neighbours(awkward.repartition(3)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(tuple, again)))
    edits = [r for r in found if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] or r["near_next"] == 1 for r in edits) >= 0.95 * len(edits)


def test_estimate_of_phrase_similarity():
    """Below the size the likeness is the Jaccard similarity of the phrase sets, above it an estimate."""
    chance = random.Random(8)
    for n, bound in ((5, 1e-12), (20, 1e-12), (400, 0.15)):
        for _ in range(20):
            a = prose(chance, n)
            b = edited(chance, a, chance.choice([0.02, 0.2, 1.0]))
            assert abs(likeness(text_signature(a, 128), text_signature(b, 128)) - jaccard(a, b)) <= bound
    assert len(text_signature(prose(chance, 400))) == phrases.SIZE


def test_phrases_and_hashes():
    seen, fresh = set(), []
    assert phrases.parsed(seen, fresh, b"aababcabcd", 0, 0) == 10 and fresh == [b"a", b"ab", b"abc", b"abcd"] and seen == set(fresh)
    long = "x" * 50_000
    assert len(phrase_set(long)) == len(text_signature(long, 10_000))  # phrases of up to 316 bytes, no two hashes alike
    assert list(text_signature("")) == [] and likeness(text_signature(""), text_signature("")) == 1.0
    assert likeness(text_signature(""), text_signature("a")) == 0.0
    for text in ("", "a", long, prose(random.Random(1), 300)):
        sig = text_signature(text)
        assert list(phrases._from_hex(phrases._hex(sig))) == list(sig)
    whole = [set(map(int, text_signature(prose(random.Random(k), 300), 10**6))) for k in (1, 2)]
    least = sorted(whole[0] | whole[1])[:128]
    exact = len(whole[0] & whole[1] & set(least)) / 128
    assert likeness(*(text_signature(prose(random.Random(k), 300)) for k in (1, 2))) == exact


def test_fingerprints_of_a_table(awkward, nothing):
    found = fingerprint_documents(awkward)
    assert found.columns == [*awkward.columns, "fingerprint"]
    by_text = {}
    for r in found.collect():
        assert by_text.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
        assert r["fingerprint"] == text_signature(r["text"]).astype(">u4").tobytes().hex()
    same = found.select(likeness_of(F.col("fingerprint"), F.col("fingerprint")).alias("s"))
    assert {r["s"] for r in same.collect()} == {1.0}
    assert fingerprint_documents(nothing).collect() == [] and edited_neighbours(nothing).collect() == []
