"""Dear columns of messages are worked out once."""

import pytest

from wardline.operators import retrieval as RT, rules as RU

CARD = (
    "id string, version string, status string, reviewer string, trigger_rule_ids array<string>, trigger_signal_kinds array<string>,"
    " retrieval_aliases map<string,array<string>>, mechanism string, red_flags array<string>, verify_steps array<string>,"
    " questions array<string>, reviewed_case_ids array<string>"
)
MESSAGE = "msg_id string, text string, minimized string, hits array<struct<rule_id:string>>, signals array<struct<kind:string,note:string>>"
RULE = "rule_order long, rule_id string, family string, desc string, message_key string, severity int, emits_signal string, match map<string,array<string>>"


def card(name, alias):
    return (name, "1", "approved", "me", ["r1"], ["card"], {"uz_latn": [alias]}, "m", ["f"], ["v"], ["q"], ["case"])


@pytest.fixture
def counted(spark):
    """Messages, and how many of them their source has given so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(f"m{k}", t, t, [("r1",)] if k % 3 else [], [("card", None)] if k % 2 else []) for k, t in enumerate(["send the secret code now", "Nothing", None] * 4)]
    return spark.createDataFrame(rows, MESSAGE).coalesce(1).mapInArrow(count, MESSAGE), seen


def test_card_impact_looks_aliases_up_once(spark, counted):
    base = spark.createDataFrame([card("a", "unmistakable words"), card("b", "secret code")], CARD)
    new = spark.createDataFrame([card("c", "secret")], CARD)
    found = RT.card_impact(counted[0], base, new)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found, RT.retrieve(counted[0], base.unionByName(new)))]
    assert plans[0].count("unmistakable") == plans[1].count("unmistakable") > 0
    modes = ["rule" if k % 3 else "signal" if k % 2 else "cue" for k in range(12)]
    assert {(r.msg_id, r.retrieval_mode) for r in found.collect()} == {(f"m{k}", mode) for k, mode in enumerate(modes)}


def test_many_cards_read_messages_once(spark, counted):
    messages, seen = counted
    cards = spark.createDataFrame([card("a", "the secret"), card("b", "secret code")], CARD)
    many = RT.retrieve(messages, cards, inline_limit=0).select("msg_id", "card_ids", "retrieval_mode")
    got = sorted(map(repr, many.collect()))
    assert seen.value == 12
    assert got == sorted(map(repr, RT.retrieve(messages, cards).select("msg_id", "card_ids", "retrieval_mode").collect()))


def test_large_packs_read_messages_twice_at_most(spark, counted):
    messages, seen = counted
    packs = [(k, f"r{k}", "f", "d", "m", 1, None, {"uz_latn": [p]}) for k, p in enumerate(["the secret code now", "ecret", "no", "n"])]
    patterns = RU.flatten_rules(spark.createDataFrame(packs, RULE))
    rows = sorted(map(repr, RU.rule_hits(messages.drop("hits"), patterns, inline_limit=0).collect()))
    assert seen.value <= 24  # once for the distinct texts, once for the rows
    assert rows == sorted(map(repr, RU.rule_hits(messages.drop("hits"), patterns).collect())) and len(rows) == 24
