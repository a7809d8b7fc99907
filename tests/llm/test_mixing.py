"""Mixing: targets against repeated resharing, totals near them, bounds and reruns."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wardline.llm import mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    rest, open_ones, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_ones:
        level = rest / sum(weight[s] for s in open_ones)
        capped = {s for s in open_ones if level * weight[s] > 2 * sizes[s]}
        if not capped:
            out |= {s: level * weight[s] for s in open_ones}
            break
        out |= {s: 2.0 * sizes[s] for s in capped}
        rest -= sum(2 * sizes[s] for s in capped)
        open_ones -= capped
    return out


def mixed(df):
    sized = df.withColumn("size", mixing.text_size(F.col("text")))
    return mixing.mix(sized)


def check(rows, df):
    sizes = defaultdict(int)
    for i, t in rows:
        sizes[None if i is None else f"s{i % 4}"] += len((t or "").encode().split())
    want, got = targets(sizes), mixed(df).collect()
    assert len(got) == len(rows)
    taken, biggest = Counter(), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    return want, taken, biggest


def test_awkward_rows(awkward, awkward_rows):
    want, taken, biggest = check(awkward_rows, awkward)
    assert all(abs(taken[s] - want[s]) <= 3 * biggest[s] for s in want)
    again = [sorted(repr(tuple(r)) for r in mixed(awkward.repartition(n)).collect()) for n in (1, 5)]
    assert again[0] == again[1]


def test_many_rows_and_levels(frame, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    chance = random.Random(1)
    rows = [(k * (4 if k % 3 else 1), "w " * chance.randrange(0, 60)) for k in range(1500)]
    want, taken, _ = check(rows, frame(rows))
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 120 for s in want)


def test_fractions_are_unbiased(frame):
    rows = [(k, "a b c d") for k in range(60)]
    count = Counter()
    for seed in range(12):
        for r in mixing.mix(frame(rows).withColumn("size", mixing.text_size(F.col("text"))), seed=seed).collect():
            count[r["doc_id"]] += r["copies"]
    assert len({count[k] for k in count}) > 1 and 0.9 < sum(count.values()) / (12 * 90) < 1.1


def test_empty_table(nothing, frame):
    assert mixed(nothing).collect() == []
    assert [r["copies"] for r in mixed(frame([(1, ""), (2, None)])).collect()] == [0, 0]
