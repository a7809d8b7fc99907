"""Near duplicates against all pairs."""

import random
import re

import pytest

from wardline.llm import minhash
from wardline.llm.graph import components

from samples import edited, prose


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets.append(grams)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = ids.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return out


def canonical(rows):
    return sorted(map(repr, rows))


def found(df):
    return [tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]


def test_awkward_rows(awkward, awkward_rows):
    assert canonical(found(awkward)) == canonical(brute(awkward_rows))


def test_near_copies_and_common_passages(frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    chance = random.Random(2)
    base, passage = prose(chance, 150), prose(chance, 55)
    rows = [(k, edited(chance, base, 0.04)) for k in range(70)]
    rows += [(100 + k, passage + " " + prose(chance, 40)) for k in range(60)]
    rows += [(200 + k, edited(chance, passage, 0.02)) for k in range(12)]
    assert canonical(found(frame(rows))) == canonical(brute(rows))


def test_empty_table(nothing):
    assert found(nothing) == []


def test_one_of_each_stays(awkward, awkward_rows):
    kept = sorted(repr(tuple(r)) for r in minhash.keep_one_of_each(awkward).select("doc_id", "text").collect())
    wanted = sorted(repr(row) for row, verdict in zip(awkward_rows, brute(awkward_rows), strict=True) if verdict[3] or verdict[2] is None)
    assert kept == wanted


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    chance = random.Random(3)
    n = 200
    links = {
        "path": [(k, k + 1) for k in range(n)],
        "star": [(n, k) for k in range(n)],
        "random": [(chance.randrange(n), chance.randrange(n)) for _ in range(120)] + [(5, 5)],
    }[shape]
    root = {x: x for pair in links for x in pair}
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == root
