import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import retrieval as RT, rules as RU
from wardline.operators.matching import match_literals, one_of_literals
from wardline.plans.screening import screen


def rule(order, rule_id, match, family="fam", severity=2, emits=None):
    return (order, rule_id, family, "desc", "key", severity, emits, match)


@pytest.fixture
def rules(spark):
    rows = [
        rule(0, "fs.otp", {"uz_latn": ["sms kod", "  "], "ru": ["код из смс"]}, "credential", 3, "otp_request"),
        rule(1, "fs.pay", {"ru": ["Предоплата", "на карту"]}, "upfront", 2),
        rule(2, "fs.rx", {"ru": ["regex:\\d+ сум", "regex:([bad"]}, "amount", 1),
        rule(3, "fs.tiny", {"uz_latn": ["xy"]}, "tiny", 1),
    ]
    return spark.createDataFrame(rows, schemas.RULES)


@pytest.fixture
def messages(spark):
    rows = [
        (1, "SMS  KOD ni yuboring"), (2, "Пришлите КОД ИЗ СМС, предоплата на карту"), (3, "дай 500 СУМ"),
        (4, "nothing"), (5, ""), (6, "zxyz"),
    ]
    return spark.createDataFrame(rows, "msg_id int, text string").withColumn("input_type", F.lit("text"))


EXPECTED = {(1, "fs.otp"), (2, "fs.otp"), (2, "fs.pay"), (3, "fs.rx"), (6, "fs.tiny")}


@pytest.mark.parametrize("limit", [4000, 0])
def test_rule_hits_both_ways(rules, messages, limit):
    hits = RU.rule_hits(messages, RU.flatten_rules(rules), inline_limit=limit) if limit else RU.rule_hits(
        messages, RU.flatten_rules(rules), inline_limit=1
    )
    assert {(r.msg_id, r.rule_id) for r in hits.collect()} == EXPECTED


def test_hits_keep_pack_order_and_fields(rules, messages):
    matched = RU.with_rule_hits(RU.with_normalized(messages), RU.flatten_rules(rules))
    hits = {r.msg_id: [(h.rule_id, h.family, h.severity) for h in r.hits] for r in matched.collect()}
    assert hits[2] == [("fs.otp", "credential", 3), ("fs.pay", "upfront", 2)]
    assert hits[4] == [] and hits[5] == []


def test_matching_patterns_and_signals(rules, messages):
    patterns = RU.flatten_rules(rules)
    found = {(r.msg_id, r.pattern) for r in RU.matching_patterns(messages, patterns).collect()}
    assert {(2, "Предоплата"), (2, "на карту"), (3, "regex:\\d+ сум")} <= found and len(found) == 6
    signals = RU.rule_signals(RU.rule_hits(messages, patterns)).collect()
    assert {(s.msg_id, s.kind, s.note) for s in signals} == {(1, "otp_request", "credential"), (2, "otp_request", "credential")}


def test_literal_scan_pattern_agrees_with_contains(spark, apply_column):
    needles = ["a.b", "a.c", "abc", "ab", "(x)", "long phrase here", "привет", "p[1]", "q", "r", "s$"]
    texts = ["xxa.bxx", "a-b", "zab", "f(x)", "a long phrase here!", "скажи привет", "p[1]", "nope: l", "s$"]
    found = apply_column(lambda t: t.rlike(one_of_literals(needles)), texts)
    assert found == [any(n in t for n in needles) for t in texts]


def test_match_literals_agrees_with_brute_force(spark):
    needles = ["one two three", "two", "wo thr", "x", "three four five six", "no such", "e t", " two "]
    texts = ["one two three four", "three four five six", "x y z", "two", "twothree", "a  two  b"]
    lits = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "lit_id bigint, needle string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = sorted(tuple(r) for r in match_literals(df, "id", "t", lits, page_size=2).collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if n in t)


def test_pack_problems(spark):
    rows = [rule(0, "a.b", {"ru": ["x1"]}), rule(1, "a.b", {"ru": ["x2"]}), rule(2, "a.c", {"ru": [" "]})]
    found = RU.rule_pack_problems(spark.createDataFrame(rows, schemas.RULES)).collect()
    assert {(r.rule_id, r.problem) for r in found} == {("a.b", "duplicate_rule_id"), ("a.c", "no_patterns")}


def override(rule_id, match, disabled=False, day=1, severity=2, family="new"):
    return (rule_id, family, "d", "key", severity, None, match, disabled, dt.datetime(2024, 1, day))


def test_merge_rules(spark, rules):
    overrides = spark.createDataFrame(
        [
            override("fs.pay", {"ru": ["новый"]}), override("fs.rx", {"ru": ["zzz"]}, disabled=True),
            override("fs.add1", {"ru": ["abc"]}, day=2), override("fs.add2", {"ru": ["abc"]}, day=3),
            override("fs.tiny", {"ru": [" "]}),
        ],
        schemas.RULE_OVERRIDES,
    )
    merged = RU.merge_rules(rules, overrides).orderBy("rule_order").collect()
    assert [(r.rule_id, r.family) for r in merged] == [
        ("fs.otp", "credential"), ("fs.pay", "new"), ("fs.tiny", "tiny"), ("fs.add2", "new"), ("fs.add1", "new"),
    ]


def test_validate_rule_overrides(spark):
    ok = {"ru": ["abc"]}
    rows = [
        override(" FS.Good ", ok), override("bad id", ok), override("fs.sev", ok, severity=4), override("fs.short", {"ru": ["ab"]}),
        override("fs.lang", {"en": ["abc"]}), override("fs.regex", {"ru": ["regex:([x"]}), override("fs.none", {"ru": [" "]}),
        override("fs.many", {"ru": ["abc"] * 61}), override("fs.off", {"ru": [" "]}, disabled=True), override("fs.long", {"ru": ["y" * 121]}),
    ]
    parts = RU.validate_rule_overrides(spark.createDataFrame(rows, schemas.RULE_OVERRIDES))
    assert {r.rule_id for r in parts["valid"].collect()} == {"fs.good", "fs.off"}
    assert {r.rule_id: r.reason for r in parts["quarantine"].collect()} == {
        "bad id": "invalid_rule_id", "fs.sev": "invalid_severity", "fs.short": "pattern_too_short",
        "fs.lang": "invalid_pattern_language", "fs.regex": "invalid_regex", "fs.none": "no_patterns",
        "fs.many": "invalid_patterns", "fs.long": "pattern_too_long",
    }


def card(card_id, rules=(), kinds=(), aliases=(), cases=(), status="approved"):
    return (card_id, "1.0", status, "me", list(rules), list(kinds), {"ru": list(aliases)}, "why", ["f"], ["v"], ["q"], list(cases))


def test_retrieve_orders_mandatory_then_score_then_id(spark, rules, messages):
    cards = spark.createDataFrame(
        [
            card("c.b", rules=["fs.pay"], cases=["case.1"]), card("c.a", kinds=["otp_request"], cases=["case.2", "case.1"]),
            card("c.z", aliases=["код", "смс", "Пришлите"]), card("c.y", aliases=["карту"]), card("c.d", rules=["fs.pay"], status="draft"),
        ],
        schemas.CARDS,
    )
    approved = RT.load_cards(cards)["approved"]
    screened = screen(messages, RU.flatten_rules(rules), approved)
    rows = {r.msg_id: r for r in screened.collect()}
    assert rows[5].status == "empty_input" and rows[5].hits == [] and rows[5].card_ids == []
    assert rows[2].card_ids == ["c.a", "c.b", "c.z"] and rows[2].retrieval_mode == "rule"
    assert rows[2].reviewed_case_ids == ["case.2", "case.1"]
    assert (rows[1].card_ids, rows[1].retrieval_mode) == (["c.a"], "signal")
    assert (rows[4].card_ids, rows[4].retrieval_mode, rows[4].retrieval_status) == ([], "none", "empty")
    joined = RT.retrieve(screened.drop("card_ids", "retrieval_mode", "retrieval_status", "reviewed_case_ids"), approved, inline_limit=0)
    for r in joined.collect():
        want = rows[r.msg_id]
        assert (r.card_ids, r.retrieval_mode, r.retrieval_status) == (want.card_ids, want.retrieval_mode, want.retrieval_status)
        assert r.reviewed_case_ids == want.reviewed_case_ids


def test_kb_version_falls_back_when_too_long(spark):
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),)], "updated_ts timestamp")
    assert RT.kb_version("v1", ts).first().kb_version == "v1.db20240102030405"
    assert RT.kb_version("v" * 70, ts).first().kb_version == "v" * 70
    assert RT.kb_version("v1", ts.limit(0)).first().kb_version == "v1"


def _awkward(spark):
    rows = [
        ("1", "u", "ru", "text", "Пришлите код из смс"), ("1", "u", "ru", "text", "nothing at all"), (None, "u", "ru", "text", "Пришлите код из смс"),
        (None, "u", "ru", "text", None), ("2", "u", None, "text", "Пришлите код из смс"), ("3", "u", None, "text", ""),
    ]
    return spark.createDataFrame(rows, "msg_id string, user_key string, language string, input_type string, text string")


def _pack(spark):
    return RU.flatten_rules(
        spark.createDataFrame(
            [(1, "a.code", "fam", "d", "k", 3, "otp_request", {"ru": ["пришлите код", "regex:код\\s+из", "из смс"]}), (2, "a.none", "fam", "d", "k", 1, None, {"ru": ["at all"]})],
            "rule_order int, rule_id string, family string, desc string, message_key string, severity int, emits_signal string, match map<string,array<string>>",
        )
    )


def _bag(df):
    return sorted(map(repr, df.collect()))


def test_both_paths_agree_on_null_and_repeated_ids(spark):
    messages, patterns = _awkward(spark), _pack(spark)
    assert _bag(RU.rule_hits(messages, patterns)) == _bag(RU.rule_hits(messages, patterns, inline_limit=0))
    assert len(RU.rule_hits(messages, patterns).collect()) == 4
    inline = RU.matching_patterns(messages, patterns)
    assert _bag(inline) == _bag(RU.matching_patterns(messages, patterns, inline_limit=0).select(*inline.columns))
    matched = RU.with_rule_hits(RU.with_normalized(messages), patterns)
    joined = RU.with_rule_hits(RU.with_normalized(messages), patterns, inline_limit=0)
    assert matched.columns == joined.columns and _bag(matched) == _bag(joined)
    cards = RT.load_cards(spark.createDataFrame([card("c.a", rules=["a.code"], cases=["case.1"]), card("c.b", aliases=["код", "смс"]), card("c.c", kinds=["otp_request"])], schemas.CARDS))["approved"]
    texts = messages.withColumnRenamed("text", "minimized")
    aliases = RT.card_aliases(cards)
    assert _bag(RT.cue_scores(texts, aliases)) == _bag(RT.cue_scores(texts, aliases, inline_limit=0))
    screened = screen(messages, patterns)
    one, other = (RT.retrieve(screened, cards, inline_limit=n) for n in (4000, 0))
    columns = ["msg_id", "text", "card_ids", "retrieval_mode", "retrieval_status", "reviewed_case_ids"]
    assert _bag(one.select(*columns)) == _bag(other.select(*columns))


def test_screen_keeps_every_message(spark):
    long = "Пришлите код из смс " * 500
    messages = _awkward(spark).union(spark.createDataFrame([("9", "u", "uz_latn", "text", long), ("8", "u", "ru", "text", " Спасибо! ")], "a string, b string, c string, d string, e string"))
    messages = messages.selectExpr("*", "array(named_struct('kind', 'qr', 'note', cast(null as string))) AS content_signals")
    phrases = spark.createDataFrame([("спасибо",)], "phrase string")
    rows = screen(messages, _pack(spark), phrases=phrases).collect()
    assert len(rows) == 8
    by_id = {r.msg_id: r for r in rows if r.msg_id in ("2", "3", "8", "9")}
    assert [h.rule_id for h in by_id["9"].hits] == ["a.code"] and by_id["9"].status is None
    assert by_id["8"].status == "meta" and by_id["8"].hits == [] and by_id["8"].signals == []
    assert by_id["3"].status == "empty_input" and ("qr", None) in [tuple(s) for s in by_id["2"].signals]
    labelled = {r.msg_id: r for r in screen(messages, _pack(spark), limit=6000).collect()}
    assert labelled["9"].status == "unsupported_media" and [h.rule_id for h in labelled["9"].hits] == ["a.code"]


def test_cards_without_id_are_quarantined(spark):
    rows = [card("c.a"), card(None), card(None)]
    parts = RT.load_cards(spark.createDataFrame(rows, schemas.CARDS))
    assert [r.id for r in parts["approved"].collect()] == ["c.a"]
    assert [r.reason for r in parts["quarantine"].collect()] == ["invalid_id", "invalid_id"]


def test_message_keys_do_not_collide(spark):
    from wardline.sources.readers import conversations_as_messages, documents_as_messages, pages_as_messages

    turns = spark.createDataFrame([(1, 1000, "user", "a"), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(1, "t", "en", "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "u")], "page_id long, url string")
    every = conversations_as_messages(turns).union(documents_as_messages(docs)).union(pages_as_messages(pages))
    assert every.select("msg_id").distinct().count() == 4
