import pytest
from pyspark.sql import functions as F

from wardline import draft_values as D, schemas
from wardline.operators import drafts as DQ, evals


def draft(i, pattern="", flags=("f",), verify=("v",), ask=("a",), addressed=("fs.a",), hits=(("fs.a", 2),), lang="ru", cards=()):
    return (str(i), lang, list(flags), pattern, list(verify), list(ask), list(addressed), list(hits), list(cards))


CASES = [
    (draft(0), None),
    (draft(1, "это мошенник!"), D.REASON_BANNED_WORD),
    (draft(2, "небезопасно"), None),
    (draft(3, "s​afe"), D.REASON_BANNED_WORD),
    (draft(4, "fail-safe mode"), None),
    (draft(5, "тут мошенничествами пахнет"), D.REASON_DIRECT_VERDICT),
    (draft(6, "вероятность обмана 80 %: риск 80%"), D.REASON_RISK_SCORE),
    (draft(7, "go to shop.example"), D.REASON_CONTACT_OR_URL),
    (draft(8, "дата 2024-01-15"), D.REASON_PHONE),
    (draft(9, "дата 2024-01-15", hits=(("fs.a", 2), ("shared.link.blocklisted", 3)), addressed=("fs.a", "shared.link.blocklisted")), None),
    (draft(10, "AB 1234567"), D.REASON_PASSPORT),
    (draft(11, "код: 1234"), D.REASON_SECRET),
    (draft(12, "перейдите по ссылке"), D.REASON_UNSAFE),
    (draft(13, "see card.xy", cards=("Card.XY",)), D.REASON_CONTACT_OR_URL),
    (draft(14, "see card_x", cards=("Card_X",)), D.REASON_INTERNAL_ID),
    (draft(15, "Деньги пришли."), D.REASON_PAYMENT),
    (draft(16, "Скриншот не доказывает, что деньги пришли."), None),
    (draft(17, "Не доказательство. Деньги пришли."), D.REASON_PAYMENT),
    (draft(18, "the same case proves it"), D.REASON_CASE_PROOF),
    (draft(19, "мы проверили базу"), D.REASON_EXTERNAL_LOOKUP),
    (draft(20, "есть в чёрном списке"), D.REASON_BLOCKLIST),
    (draft(21, "привет", lang="uz_latn"), D.REASON_SCRIPT),
    (draft(22, verify=()), D.REASON_VERIFY_EMPTY),
    (draft(23, ask=()), D.REASON_ASK_EMPTY),
    (draft(24, flags=()), D.REASON_RED_FLAGS_EMPTY),
    (draft(25, flags=(), hits=(("fs.a", 1),)), None),
    (draft(26, addressed=("fs.a", "fs.b")), D.REASON_UNKNOWN_RULES),
    (draft(27, addressed=()), D.REASON_MISSING_RULES),
    (draft(28, addressed=(), hits=(("fs.a", 1),)), None),
]


def test_draft_qa_reasons(spark):
    judged = DQ.draft_qa(spark.createDataFrame([c[0] for c in CASES], schemas.DRAFTS)).collect()
    got = {int(r.check_id): r.reason for r in judged}
    assert got == {int(c[0][0]): c[1] for c in CASES}
    assert all(r.ok == (r.reason is None) for r in judged)


def test_assistant_names_extend_lookup_claims(spark):
    df = spark.createDataFrame([draft(0, "helper checked the database")], schemas.DRAFTS)
    assert DQ.draft_qa(df).first().reason is None
    assert DQ.draft_qa(df, ("helper",)).first().reason == D.REASON_EXTERNAL_LOOKUP


def test_truncation_and_no_signal(spark):
    df = spark.createDataFrame([draft(0, flags=(), verify="abcd", hits=(), addressed=())], schemas.DRAFTS)
    row = DQ.draft_qa(df).first()
    assert (len(row.verify), row.no_signal, row.ok) == (3, True, True)


def test_resolve_attempts(spark):
    rows = [
        (1, 1, False, "x", 10, 1), (1, 2, True, None, 20, 2), (2, 1, True, None, 5, 1), (2, 2, True, None, 9, 9),
        (3, 1, False, "x", 1, 1), (3, 2, False, "y", 2, 2), (3, 3, True, None, 4, 4),
    ]
    df = spark.createDataFrame(rows, "check_id int, attempt int, ok boolean, reason string, input_tokens int, output_tokens int")
    got = {r.check_id: (r.outcome, r.winner, r.reason, r.input_tokens) for r in DQ.resolve_attempts(df).collect()}
    assert got == {1: ("ok", 2, None, 30), 2: ("ok", 1, None, 5), 3: ("safety_fallback", None, "y", 3)}


def test_token_cost_is_exact(spark):
    events = spark.createDataFrame([("m", 1234567, 89)], "model string, input_tokens int, output_tokens int")
    rates = spark.createDataFrame([("m", 0.15, 0.6)], "model string, in_rate_per_m double, out_rate_per_m double")
    assert float(DQ.token_cost(events, rates).first().cost_usd) == round(1234567 / 1e6 * 0.15 + 89 / 1e6 * 0.6, 6)


@pytest.mark.parametrize(
    "raw,ok",
    [
        ('{"verify": ["a"]}', True), ('```json\n{"ask": ["b"]}\n```', True), ('text {"ask": []} more', True),
        ('{"a": 1}}', False), ("[1]", False), ("", False), ("{broken", False), ('{"a": 1} {"b": 2}', False),
    ],
)
def test_parse_drafts(spark, raw, ok):
    row = evals.parse_drafts(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row.json_ok is ok and row.addressed_rule_ids == []


def test_eval_rubric(spark):
    raw = '{"red_flags": ["Просят код"], "verify": ["Позвоните в банк"], "ask": ["Зачем?"], "pattern": "небезопасно"}'
    df = spark.createDataFrame([("p", raw, "ru", False), ("p", "nope", "ru", False)], "provider string, raw string, language string, expects_no_signal boolean")
    scores = evals.eval_rubric(evals.parse_drafts(df))
    assert [r.total for r in scores.orderBy(F.desc("total")).collect()] == [7, 0]
    board = evals.eval_leaderboard(scores).first()
    assert (board.points, board.max_points, board.failing_outputs) == (7, 14, 1)


def test_outputs_are_parsed_once_for_all_checks(spark):
    rows = [("alpha", "ru", False, '{"red_flags": ["a"], "verify": ["b"]}', "1"), ("beta", "ru", True, "nothing", "2")]
    df = spark.createDataFrame(rows, "provider string, language string, expects_no_signal boolean, raw string, answer_id string")
    failing = evals.failing_fixtures(evals.eval_rubric(evals.parse_drafts(df)))
    plan = evals.failing_fixtures(evals.eval_rubric(evals.parse_drafts(df.repartition(2))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1 and plan.count(" rlike ") <= 12
    assert {r.answer_id for r in failing.collect()} == {"1", "2"}
