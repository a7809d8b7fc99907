import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions.keys import pseudonymize
from wardline.operators import alerts, events as EV, gaps, labels, metrics as M
from wardline.operators.common import salted_join
from wardline.sources.writers import metrics_long

DAY = dt.datetime(2024, 1, 10)
DEFAULTS = dict(
    input_type="text", language="ru", rule_ids=[], knowledge_card_ids=[], reviewed_case_ids=[], retrieval_mode=None,
    retrieval_status=None, router_status=None, kb_version="v1", no_signal=False, status="ok", error_class=None,
    ocr_confidence=None, latency_ms=100, ocr_ms=None, llm_ms=None, input_tokens=None, output_tokens=None, cost_usd=None,
    safety_blocked=False,
)


def events(spark, rows):
    full = [{**DEFAULTS, "id": str(i), "user_key": "u", "ts": DAY, **r} for i, r in enumerate(rows)]
    names = [f.name for f in spark.createDataFrame([], schemas.CHECK_EVENT).schema]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.CHECK_EVENT)


def feedback(spark, rows):
    return spark.createDataFrame([(c, u, a, DAY) for c, u, a in rows], schemas.FEEDBACK)


@pytest.mark.parametrize("secret", ["s", "k" * 100])
def test_pseudonymize_is_hmac(apply_column, secret):
    want = [hmac.new(secret.encode(), f"web:{v}".encode(), hashlib.sha256).hexdigest()[:32] for v in ("42", "ключ")]
    assert apply_column(lambda t: pseudonymize(t, secret, "web:"), ["42", "ключ"]) == want


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_admit_equals_step_by_step_counting(spark, limit):
    rng = random.Random(limit)
    rows = [
        {"user_key": rng.choice("aab"), "ts": DAY + dt.timedelta(minutes=rng.randrange(3000)), "status": rng.choice(["ok", "timeout", "off_topic", "meta"])}
        for _ in range(120)
    ]
    df = events(spark, rows)
    used, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.id)):
        key = (r.user_key, r.ts.date())
        want[r.id] = used.get(key, 0) < limit
        used[key] = used.get(key, 0) + (r.status in ("ok", "off_topic"))
    assert {r.id: r.admitted for r in EV.admit(df, limit).collect()} == want
    counts = {(r.user_key, r.day): r["count"] for r in EV.usage_counters(df).collect()}
    assert counts == used


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "k string, v int")
    for how in ("inner", "left"):
        plain = sorted(map(str, big.join(small, "k", how).select("i", "k", "v").collect()))
        assert sorted(map(str, salted_join(big, small, ["k"], how, F.col("i")).select("i", "k", "v").collect())) == plain


def test_feedback_upsert_keeps_last_action(spark):
    t = lambda m: DAY + dt.timedelta(minutes=m)
    taps = spark.createDataFrame(
        [("1", "yes", None, t(0)), ("1", "no", "verify", t(1)), ("1", "partly", None, t(2)), ("2", "bad", None, t(0)), ("3", "yes", "dance", t(0))],
        schemas.FEEDBACK,
    )
    rows = EV.upsert_feedback(taps.limit(0), taps).collect()
    assert [(r.check_id, r.usefulness, r.next_action, r.ts) for r in rows] == [("1", "partly", "verify", t(2))]


def test_validate_events_and_leaks(spark):
    df = events(spark, [{}, {"status": "weird"}, {"rule_ids": ["Bad"]}, {"kb_version": "a b"}, {"error_class": "call +998 90 123 45 67"}])
    parts = EV.validate_events(df)
    assert {r.id: r.reason for r in parts["quarantine"].collect()} == {"1": "status", "2": "rule_ids", "3": "kb_version", "4": "error_class"}
    leaks = {(r.column, r.kind): r["values"] for r in EV.leak_scan(df.drop("id")).collect() if r["values"]}
    assert leaks == {("kb_version", "shape"): 1, ("error_class", "phone"): 1}


def test_retention_is_strict_and_takes_feedback_along(spark):
    now = dt.datetime(2024, 6, 1)
    ago = lambda d: now - dt.timedelta(days=d)
    tables = {
        "check_event": events(spark, [{"ts": ago(90)}, {"ts": ago(91)}]),
        "feedback": spark.createDataFrame([("0", "yes", None, ago(90)), ("1", "yes", None, ago(1)), ("x", "no", None, ago(91))], schemas.FEEDBACK),
        "consent": spark.createDataFrame([("a", "v", "ru", ago(365)), ("b", "v", "ru", ago(366))], schemas.CONSENT),
        "rate_limit": spark.createDataFrame([("a", "user", ago(2).date(), 1), ("a", "user", ago(3).date(), 1)], schemas.RATE_LIMIT),
        "deletion_log": spark.createDataFrame([("1", "k", ago(400), ago(1)), ("2", "k", ago(400), None), ("3", "k", ago(400), ago(366))], schemas.DELETION_LOG),
        "story_submission": spark.createDataFrame(
            [("1", "u", "ru", "", "rejected", ago(99), ago(10)), ("2", "u", "ru", "", "rejected", ago(99), None), ("3", "u", "ru", "", "new", ago(99), None)],
            schemas.STORY_SUBMISSION,
        ),
    }
    kept, removed = EV.apply_retention(tables, F.lit(now))
    assert {r.table: r.removed for r in removed.collect()} == {
        "check_event": 1, "feedback": 2, "consent": 1, "rate_limit": 1, "deletion_log": 2, "story_submission": 1,
    }
    assert [r.check_id for r in kept["feedback"].collect()] == ["0"]


def test_erase_users(spark):
    empty = lambda s: spark.createDataFrame([], s)
    tables = {
        "check_event": events(spark, [{"user_key": "a"}, {"user_key": "b"}]), "feedback": feedback(spark, [("0", "yes", None), ("1", "no", None)]),
        "consent": spark.createDataFrame([("a", "v", "ru", DAY)], schemas.CONSENT), "rate_limit": empty(schemas.RATE_LIMIT),
        "story_submission": empty(schemas.STORY_SUBMISSION), "deletion_log": empty(schemas.DELETION_LOG),
    }
    kept = EV.erase_users(tables, spark.createDataFrame([("a",), ("a",)], "user_key string"), F.lit(DAY))
    assert [r.id for r in kept["check_event"].collect()] == ["1"] and [r.check_id for r in kept["feedback"].collect()] == ["1"]
    assert kept["consent"].count() == 0
    (log,) = kept["deletion_log"].collect()
    assert log.user_key == hashlib.sha256(b"deletion-log:a").hexdigest()[:32]


def test_posts(spark):
    assert spark.range(1).select(EV.reading_minutes(F.repeat(F.lit("w "), F.lit(450))).alias("m")).first().m == 2
    assert spark.range(1).select(EV.reading_minutes(F.lit("one")).alias("m")).first().m == 1


def test_metrics_summary(spark):
    df = events(
        spark,
        [
            {"user_key": "a", "cost_usd": dt_cost("0.001"), "retrieval_status": "ok", "knowledge_card_ids": ["c1"], "latency_ms": 100},
            {"user_key": "b", "status": "no_signal", "no_signal": True, "cost_usd": dt_cost("0.002"), "retrieval_status": "empty", "latency_ms": 201},
            {"user_key": "a", "status": "safety_fallback", "safety_blocked": True, "language": "uz_latn", "cost_usd": dt_cost("0.003"), "retrieval_status": "unavailable"},
        ],
    )
    consent = spark.createDataFrame([("a", "v", "ru", DAY), ("b", "v", "ru", DAY), ("c", "v", "ru", DAY)], schemas.CONSENT)
    cards = spark.createDataFrame([("c1", "approved"), ("c2", "draft")], "id string, status string")
    s = M.collect_metrics(df, consent, feedback(spark, [("0", "yes", "verify"), ("1", "no", None), ("zz", "no", None)]), cards, "v1").first()
    assert (s.checks_total, s.checks_completed, s.checks_failed, s.completion_rate) == (3, 2, 1, 0.6667)
    assert (s.consented_users, s.activated_users, s.activation_rate) == (3, 2, 0.6667)
    assert (float(s.cost_total_usd), float(s.cost_avg_success_usd), s.latency_avg_ms) == (0.006, 0.0015, 133.67)
    assert (s.no_signal_count, s.no_signal_rate, s.safety_blocked) == (1, 0.5, 1)
    assert (s.knowledge_coverage_rate, s.knowledge_unavailable_rate, s.kb_approved_cards) == (0.3333, 0.3333, 1)
    assert s.by_status == {"ok": 1, "no_signal": 1, "safety_fallback": 1} and s.by_language == {"ru": 2, "uz_latn": 1}
    assert s.usefulness == {"yes": 1, "no": 1} and s.next_action == {"verify": 1}
    empty = M.collect_metrics(df.limit(0), consent.limit(0), feedback(spark, []), cards.limit(0), "v1")
    e = empty.first()
    assert (e.checks_total, e.completion_rate, e.latency_avg_ms, float(e.cost_total_usd), e.by_status) == (0, 0.0, None, 0.0, {})
    assert {r.key: r.value for r in metrics_long(empty).collect()}["checks_total"] == "0"


def dt_cost(text):
    from decimal import Decimal

    return Decimal(text)


def test_labels(spark):
    df = events(spark, [{"rule_ids": ["r.bad", "r.bad"]}] * 5 + [{"rule_ids": ["r.good"]}] * 5)
    answers = [(str(i), "no" if i < 4 else "yes", "verify" if i != 3 else None) for i in range(10)]
    rules = spark.createDataFrame([("r.good", "fam")], "rule_id string, family string")
    rows = {r.rule_id: r for r in labels.rule_usefulness(df, feedback(spark, answers), rules).collect()}
    assert (rows["r.bad"].responses, rows["r.bad"].useful_rate, rows["r.bad"].gap_from_baseline, rows["r.bad"].candidate) == (5, 0.2, 0.4, True)
    assert (rows["r.good"].candidate, rows["r.good"].family, rows["r.bad"].family) == (False, "fam", "unmapped")
    deltas = {(r.rule_id, r.next_action): (r["count"], r.delta) for r in labels.action_deltas(df, feedback(spark, answers)).collect()}
    assert deltas == {("r.bad", "verify"): (4, 0.0), ("r.good", "verify"): (5, 0.0)}


def test_gaps(spark):
    df = events(
        spark,
        [
            {"retrieval_status": "empty", "rule_ids": ["b", "a"], "retrieval_mode": "none", "router_status": "not_used"},
            {"retrieval_status": "empty", "rule_ids": ["a", "b"], "retrieval_mode": "none", "router_status": "ok"},
            {"retrieval_status": "ok", "knowledge_card_ids": ["c1", "cx"], "retrieval_mode": "rule"}, {"retrieval_status": "unavailable"}, {},
        ],
    )
    cards = spark.createDataFrame([("c1", "approved"), ("c2", "approved"), ("c3", "draft")], "id string, status string")
    cover = gaps.gap_coverage(df).first()
    assert (cover.checks, cover.found, cover.no_match, cover.unavailable, cover.coverage_rate) == (4, 1, 2, 1, 0.25)
    (gap,) = gaps.gap_groups(df, feedback(spark, [("0", "no", None), ("1", "no", None), ("2", "no", None)])).collect()
    assert (gap.rule_ids, gap["count"]) == (["a", "b"], 2)
    assert {r.card_id: r["count"] for r in gaps.card_usage(df, cards).collect()} == {"c1": 1, "cx": 1, "c2": 0}
    assert [r.card_id for r in gaps.unused_cards(df, cards).collect()] == ["c2"]
    assert {r.key: r["count"] for r in gaps.router_health(df).collect()} == {"mode:none": 2, "mode:rule": 1, "status:ok": 1}


def test_availability_needs_an_outage(spark):
    df = events(spark, [{"retrieval_status": "ok"}] * 2 + [{"retrieval_status": "unavailable"}] * 2)
    since = "2024-01-01"
    assert [alerts.availability(df, since, t).first().alert for t in (0.5, 0.51)] == [True, False]
    assert alerts.availability(df.filter("retrieval_status = 'ok'"), since, 0.0).first().alert is False


@pytest.mark.parametrize("seed", range(3))
def test_debounce_equals_sequential_replay(spark, seed):
    rng = random.Random(seed)
    span = [4000, 40000, 400000][seed]
    rows = [("llm" if rng.random() < 0.7 else "ocr", rng.choice("AB"), DAY + dt.timedelta(seconds=rng.randrange(span))) for _ in range(400)]
    rows += [("validate", "A", DAY), ("llm", "", DAY)] + rows[:20]
    want, last = set(), {}
    for stage, kind, ts in sorted(rows, key=lambda r: r[2]):
        if stage == "validate" or not kind:
            continue
        if (stage, kind) not in last or (ts - last[stage, kind]).total_seconds() >= 900:
            last[stage, kind] = ts
            want.add((stage, kind, ts))
    df = spark.createDataFrame(rows, schemas.ERRORS)
    assert {tuple(r) for r in alerts.debounce_alerts(df).collect()} == want
    assert {tuple(r) for r in alerts.debounce_alerts(df, slice_seconds=900).collect()} == want


def test_write_and_read_events(spark, tmp_path):
    from wardline.sources.readers import read_events
    from wardline.sources.writers import write_events

    df = events(spark, [{}, {"ts": DAY + dt.timedelta(days=1)}, {"status": "weird"}])
    bad = write_events(df, str(tmp_path / "ev"))
    assert [r.id for r in bad.collect()] == ["2"]
    assert [r.id for r in read_events(spark, str(tmp_path / "ev"), "2024-01-11").collect()] == ["1"]
