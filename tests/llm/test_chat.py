"""Role repair against a search over all repairs, and against one long conversation cut into many parts."""

import itertools
import random

import pytest

from wardline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, cost string, pos string"
NEXT = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def cheapest(roles):
    """Least cost over all new roles of the turns, with merges and single insertions."""
    best = None
    for new in itertools.product(chat.ROLES, repeat=len(roles)):
        cost, state = 0, None
        for role, own in zip(new, roles, strict=True):
            cost += chat.RELABEL * (role != own)
            ways = [0] if role in NEXT[state] else []
            ways += [chat.INSERT] if any(role in NEXT[x] for x in NEXT[state]) else []
            ways += [chat.MERGE] if role == state else []
            if not ways:
                cost = None
                break
            cost, state = cost + min(ways), role
        if cost is not None:
            cost += {"assistant": 0, "user": chat.INSERT, "system": 2 * chat.INSERT}[state]
            best = cost if best is None else min(best, cost)
    return best


def spent(rows):
    total = 0
    for r in rows:
        total += chat.RELABEL * ("relabel" in r["action"]) + chat.MERGE * ("merge" in r["action"])
        total += chat.INSERT * (len(list(filter(None, r["inserted"].split(",")))) + len(list(filter(None, r["behind"].split(",")))))
    return total


def legal(rendered):
    """Roles of a rendered conversation follow the automaton and end with the assistant."""
    parts = rendered.split("<|end|>\n")
    assert parts.pop() == ""
    state = None
    for p in parts:
        role = p[2 : p.index("|>")]
        assert role in NEXT[state]
        state = role
    assert state == "assistant"


def by_conversation(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_least_cost_and_legal(spark):
    chance = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(chance.randrange(1, 7)):
            rows.append((c, t, chance.choice(["system", "user", "user", "assistant", "tool", None]), f"text {c} {t}"))
    found = by_conversation(chat.repair_roles(table(spark, rows)))
    for c, got in found.items():
        own = [r for r in rows if r[0] == c]
        assert [r["turn"] for r in got] == [r[1] for r in own]
        assert spent(got) == cheapest([r[2] for r in own])
        legal("".join(r["rendered"] for r in got))


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "System", "s"), (1, 1, "human", "u"), (1, 2, "gpt", "a"), (2, 0, "user", "u"), (2, 1, "assistant", None)]
    found = by_conversation(chat.repair_roles(table(spark, rows)))
    assert "".join(r["rendered"] for r in found[1]) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert {r["action"] for c in found.values() for r in c} == {"keep"}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_one_long_conversation_in_parts(spark, parts):
    chance = random.Random(3)
    rows = [(5, t // 2, chance.choice(["system", "user", "assistant", None]), f"t{t % 40}") for t in range(600)]
    rows += [(None, 0, "user", "x"), (None, None, "user", "y"), (6, 1, "user", ""), (6, 1, "user", "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = by_conversation(chat.repair_roles(table(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["pos"] for r in found[5]] == list(range(600)) and len(found[None]) == 2
    for rows_of in found.values():
        legal("".join(r["rendered"] for r in rows_of))
    costs = chat._END.copy()
    for r in reversed(found[5]):
        costs = (chat._COST[chat._given(r["role"])] + costs[None, :]).min(axis=1)
    assert spent(found[5]) == costs[chat.START]


def test_empty_table(spark):
    assert chat.repair_roles(spark.createDataFrame([], SCHEMA)).collect() == []
