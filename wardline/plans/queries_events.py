"""Registered queries: event tables, metrics, labels, gaps, alerts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions.keys import pseudonymize
from wardline.operators import alerts, events as EV, gaps, labels, metrics as M
from wardline.operators.common import scratch_dir
from wardline.plans.oracle_sql import choose, edge, norm, quoted, stamp
from wardline.plans.queries_text import BLOCK_ROWS_SQL, BLOCK_UPSERT_SQL, FEED_TIME, STRUCTURAL_SQL, feed_hashes
from wardline.plans.registry import query
from wardline.plans.views import KB_VERSION, Views, pick
from wardline.sources.readers import read_events, read_message_stream, read_table_stream
from wardline.sources.writers import METRIC_KEYS, metrics_long, write_events
from wardline.streaming import streams as K

NOW = "2024-02-01"
SINCE, UNTIL = "2024-01-08", "2024-01-22"
_WINDOW = f"ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'"
_DONE = "status IN ('ok', 'no_signal')"
_BILLABLE = "status IN ('ok', 'no_signal', 'low_ocr', 'off_topic', 'safety_fallback')"

# --- A: sinks ---------------------------------------------------------------------------------------


@query(
    "write_events",
    f"SELECT id, status, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, array_to_string(rule_ids, ',') AS rule_ids, {_WINDOW} AS pruned FROM check_event",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    path = f"{scratch_dir(v.spark)}/events"
    write_events(v.check_event.drop("k"), path, mode="overwrite")
    whole = read_events(v.spark, path).select("id", "status", "day", "rule_ids")
    pruned = read_events(v.spark, path, SINCE, UNTIL).select("id", F.lit(True).alias("pruned"))
    return whole.join(pruned, "id", "left").withColumn("pruned", F.coalesce("pruned", F.lit(False)))


# --- L: event-table operations ----------------------------------------------------------------------

_SECRET = b"secret".ljust(64, b"\0")


def _hex_bytes(value: int) -> str:
    return "".join(f"\\x{b ^ value:02X}" for b in _SECRET)


@query(
    "pseudonymize",
    f"""
    SELECT DISTINCT user_id, left(sha256('{_hex_bytes(0x5C)}'::BLOB || unhex(sha256('{_hex_bytes(0x36)}'::BLOB || encode('web:' || user_id)))), 32) AS user_key FROM events""",
)
def _(v: Views) -> DataFrame:
    return v.table("events").select("user_id", pseudonymize(F.col("user_id"), "secret", "web:").alias("user_key")).distinct()


def _consent_updates(v: Views) -> DataFrame:
    """Every sign-up is a new consent."""
    return v.check_event.filter("safety_blocked").select(
        "user_key", F.concat(F.lit("v"), F.col("k") % 4).alias("notice_version"), "language", "ts"
    )


@query(
    "upsert_consent",
    f"""
    WITH u AS (SELECT *, 0 AS fresh FROM consent UNION ALL SELECT user_key, 'v' || (k % 4), language, ts, 1 FROM check_event WHERE safety_blocked),
         r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY ts DESC, fresh DESC, notice_version DESC, language DESC) AS rn FROM u)
    SELECT user_key, notice_version, language, {stamp('ts')} AS ts FROM r WHERE rn = 1""",
    ("consent",),
)
def _(v: Views) -> DataFrame:
    return EV.upsert_consent(v.consent, _consent_updates(v))


@query(
    "consent_gate",
    "SELECT e.id, e.user_key, c.user_key IS NOT NULL AS passed FROM check_event e LEFT JOIN (SELECT user_key FROM consent WHERE notice_version = 'v2') c ON e.user_key = c.user_key",
    ("check_event", "consent"),
)
def _(v: Views) -> DataFrame:
    gate = EV.consent_gate(v.check_event.select("id", "user_key"), v.consent, "v2")
    return gate["pass"].withColumn("passed", F.lit(True)).unionByName(
        gate["needs_consent"].withColumn("passed", F.lit(False))
    )


_TAPS_SQL = """
    taps AS (SELECT id * 2 AS tap_id, id AS check_id, CASE WHEN k % 7 = 0 THEN 'stranger' ELSE user_key END AS user_key, 'usefulness' AS kind,
               CASE WHEN k % 8 = 7 THEN 'great' ELSE ['yes', 'partly', 'no'][k % 3 + 1] END AS value, ts + INTERVAL 1 HOUR AS ts FROM check_event WHERE input_type = 'text'
             UNION ALL SELECT id * 2 + 1, id, CASE WHEN k % 7 = 1 THEN 'stranger' ELSE user_key END, 'next_action',
               ['verify', 'delay_stop', 'continue', 'not_sure'][k % 4 + 1], ts + INTERVAL 1 HOUR + to_minutes(CAST(k - 50 AS INTEGER)) FROM check_event)"""


def _taps(v: Views) -> DataFrame:
    k, hour = F.col("k"), F.col("ts") + F.expr("INTERVAL 1 HOUR")

    def stranger(digit: int):
        return F.when(k % 7 == digit, "stranger").otherwise(F.col("user_key")).alias("user_key")

    rated = v.check_event.filter(F.col("input_type") == "text").select(
        (F.col("id") * 2).alias("tap_id"), F.col("id").alias("check_id"), stranger(0), F.lit("usefulness").alias("kind"),
        F.when(k % 8 == 7, "great").otherwise(pick(k, ("yes", "partly", "no"))).alias("value"), hour.alias("ts"),
    )
    acted = v.check_event.select(
        (F.col("id") * 2 + 1).alias("tap_id"), F.col("id").alias("check_id"), stranger(1), F.lit("next_action").alias("kind"),
        pick(k, ("verify", "delay_stop", "continue", "not_sure")).alias("value"),
        (hour + F.make_dt_interval(mins=(k - 50).cast("int"))).alias("ts"),
    )
    return rated.unionByName(acted)


@query(
    "authorize_feedback",
    f"""
    WITH {_TAPS_SQL}, own AS (SELECT t.* FROM taps t JOIN check_event e ON t.check_id = e.id AND t.user_key = e.user_key WHERE e.{_DONE}),
         f AS (SELECT check_id, min(ts) AS rated_at FROM own WHERE kind = 'usefulness' GROUP BY check_id)
    SELECT tap_id, own.check_id, kind, value FROM own LEFT JOIN f ON own.check_id = f.check_id WHERE kind = 'usefulness' OR rated_at < ts""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return EV.authorize_feedback(_taps(v), v.check_event).select("tap_id", "check_id", "kind", "value")


@query(
    "upsert_feedback",
    f"""
    WITH t AS (SELECT id % 4000 AS check_id, CASE WHEN k % 8 = 7 THEN 'great' ELSE ['yes', 'partly', 'no'][k % 3 + 1] END AS usefulness,
                 CASE WHEN k % 5 = 4 THEN NULL ELSE {choose('k', V.NEXT_ACTION_VALUES)} END AS next_action, ts FROM check_event),
         u AS (SELECT check_id, usefulness, next_action, ts FROM feedback UNION ALL SELECT * FROM t WHERE usefulness <> 'great'),
         a AS (SELECT check_id, arg_max(next_action, ts) FILTER (next_action IS NOT NULL) AS next_action FROM u GROUP BY check_id)
    SELECT u.check_id, arg_max(usefulness, u.ts) AS usefulness, any_value(a.next_action) AS next_action, {stamp('max(u.ts)')} AS ts FROM u JOIN a ON u.check_id = a.check_id GROUP BY u.check_id""",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    k = F.col("k")
    taps = v.check_event.select(
        (F.col("id") % 4000).alias("check_id"),
        F.when(k % 8 == 7, "great").otherwise(pick(k, ("yes", "partly", "no"))).alias("usefulness"),
        F.when(k % 5 != 4, pick(k, V.NEXT_ACTION_VALUES)).alias("next_action"), "ts",
    )
    return EV.upsert_feedback(v.feedback, taps)


@query(
    "usage_counters",
    f"SELECT user_key, 'user' AS scope, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER ({_BILLABLE}) AS count FROM check_event GROUP BY ALL",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return EV.usage_counters(v.check_event)


_ADMIT_SQL = f"""
    SELECT id, user_key, coalesce(sum(CASE WHEN {_BILLABLE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_key, CAST(ts AS DATE) ORDER BY ts, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS admitted FROM """


@query("admit", _ADMIT_SQL + "check_event", ("check_event",))
def _(v: Views) -> DataFrame:
    return EV.admit(v.check_event, limit=2).select("id", "user_key", "admitted")


@query(
    "admit_web_ip",
    _ADMIT_SQL + "(SELECT id, 'ip-' || (CAST(user_key AS BIGINT) % 10) AS user_key, ts, status FROM check_event)",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    by_ip = v.check_event.withColumn("user_key", F.concat(F.lit("ip-"), F.col("user_key").cast("bigint") % 10))
    return EV.admit(by_ip, limit=2).select("id", "user_key", "admitted")


def _spoiled(v: Views) -> DataFrame:
    k = F.col("k")
    return v.check_event.withColumns(
        {
            "input_type": F.when(k % 23 == 1, "video").otherwise(F.col("input_type")),
            "rule_ids": F.when(k % 23 == 2, F.array(F.lit("Bad Rule"))).otherwise(F.col("rule_ids")),
            "retrieval_mode": F.when(k % 23 == 3, "magic").otherwise(F.col("retrieval_mode")),
            "kb_version": F.when(k % 23 == 4, "v 1").otherwise(F.col("kb_version")),
            "error_class": F.when(k % 23 == 5, "9Error").otherwise(F.col("error_class")),
        }
    )


@query(
    "validate_events",
    """
    SELECT id, CASE k % 23 WHEN 1 THEN 'input_type' WHEN 2 THEN 'rule_ids' WHEN 3 THEN 'retrieval_mode' WHEN 4 THEN 'kb_version' WHEN 5 THEN 'error_class' END AS reason
    FROM check_event""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    parts = EV.validate_events(_spoiled(v))
    none = F.lit(None).cast("string").alias("reason")
    return parts["valid"].select("id", none).unionByName(parts["quarantine"].select("id", "reason"))


@query(
    "leak_scan",
    " UNION ALL ".join(
        f"SELECT {quoted(c)} AS \"column\", {quoted(kind)} AS kind, count(*) FILTER (regexp_matches({c}, {quoted(edge(p))})) AS values FROM (SELECT text, source, lang FROM documents)"
        for c in ("text", "source", "lang") for kind, p in V.LEAK_PATTERNS.items()
    ),
)
def _(v: Views) -> DataFrame:
    return EV.leak_scan(v.table("documents").select("text", "source", "lang"))


_GONE_SQL = "gone AS (SELECT DISTINCT user_key FROM check_event WHERE k = 42)"


@query(
    "erase_users",
    f"""
    WITH {_GONE_SQL}
    SELECT 'check_event' AS "table", count(*) AS kept FROM check_event WHERE user_key NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'consent', count(*) FROM consent WHERE user_key NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE check_id IN (SELECT id FROM check_event WHERE user_key NOT IN (SELECT * FROM gone))
    UNION ALL SELECT 'rate_limit', count(*) FROM (SELECT DISTINCT user_key, CAST(ts AS DATE) FROM check_event WHERE user_key NOT IN (SELECT * FROM gone))
    UNION ALL SELECT 'story_submission', count(*) FROM check_event WHERE status = 'llm_error' AND user_key NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'deletion_log ' || left(sha256('deletion-log:' || user_key), 32), 1 FROM gone""",
    ("check_event", "consent", "feedback"),
)
def _(v: Views) -> DataFrame:
    tables = _tables(v)
    gone = v.check_event.filter(F.col("k") == 42).select("user_key")
    kept = EV.erase_users(tables, gone, F.lit(NOW).cast("timestamp"))
    counts = None
    for name in ("check_event", "consent", "feedback", "rate_limit", "story_submission"):
        one = kept[name].agg(F.count("*").alias("kept")).select(F.lit(name).alias("table"), "kept")
        counts = one if counts is None else counts.unionByName(one)
    audit = kept["deletion_log"].filter(F.col("requested_ts") == F.lit(NOW).cast("timestamp"))
    return counts.unionByName(
        audit.select(F.concat(F.lit("deletion_log "), "user_key").alias("table"), F.lit(1).cast("bigint").alias("kept"))
    )


def _tables(v: Views) -> dict[str, DataFrame]:
    ev, none = v.check_event, F.lit(None).cast("timestamp")
    return {
        "check_event": ev,
        "feedback": v.feedback,
        "consent": v.consent,
        "rate_limit": EV.usage_counters(ev),
        "deletion_log": ev.filter(F.col("status") == "safety_fallback").select(
            F.col("id").cast("string").alias("id"), "user_key", F.col("ts").alias("requested_ts"),
            F.when(F.col("k") % 3 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("completed_ts"),
        ),
        "story_submission": ev.filter(F.col("status") == "llm_error").select(
            "id", "user_key", "language", F.lit("").alias("minimized_text"),
            F.when(F.col("k") % 2 == 0, "rejected").otherwise("new").alias("status"),
            F.col("ts").alias("created_ts"),
            F.when(F.col("k") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 DAY")).otherwise(none).alias("reviewed_ts"),
        ),
    }


_POLICY = EV.RetentionPolicy(12, 11, 25, 48, 20, 15)


@query(
    "apply_retention",
    f"""
    WITH s AS (SELECT k, ts AS created, CASE WHEN k % 3 = 0 THEN ts + INTERVAL 2 DAY END AS reviewed FROM check_event WHERE status = 'llm_error' AND k % 2 = 0),
         d AS (SELECT ts AS requested, CASE WHEN k % 3 <> 0 THEN ts + INTERVAL 1 DAY END AS completed FROM check_event WHERE status = 'safety_fallback')
    SELECT 'check_event' AS "table", count(*) AS removed FROM check_event WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 12 DAY
    UNION ALL SELECT 'feedback', count(*) FROM feedback f JOIN check_event e ON f.check_id = e.id WHERE f.ts < TIMESTAMP '{NOW}' - INTERVAL 11 DAY OR e.ts < TIMESTAMP '{NOW}' - INTERVAL 12 DAY
    UNION ALL SELECT 'consent', count(*) FROM consent WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 25 DAY
    UNION ALL SELECT 'rate_limit', count(*) FROM (SELECT DISTINCT user_key, CAST(ts AS DATE) AS day FROM check_event) WHERE day < DATE '2024-01-30'
    UNION ALL SELECT 'deletion_log', count(*) FROM d WHERE coalesce(completed, requested) < TIMESTAMP '{NOW}' - INTERVAL 20 DAY
    UNION ALL SELECT 'story_submission', count(*) FROM s WHERE coalesce(reviewed, created) < TIMESTAMP '{NOW}' - INTERVAL 15 DAY""",
    ("check_event", "feedback", "consent"),
)
def _(v: Views) -> DataFrame:
    return EV.apply_retention(_tables(v), F.lit(NOW).cast("timestamp"), _POLICY)[1]


@query(
    "retention_kept_feedback",
    f"SELECT check_id FROM feedback f JOIN check_event e ON f.check_id = e.id WHERE f.ts >= TIMESTAMP '{NOW}' - INTERVAL 11 DAY AND e.ts >= TIMESTAMP '{NOW}' - INTERVAL 12 DAY",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    return EV.apply_retention(_tables(v), F.lit(NOW).cast("timestamp"), _POLICY)[0]["feedback"].select("check_id")


@query(
    "collapse_consent",
    """
    SELECT user_key, notice_version FROM (SELECT user_key, 'v' || (k % 4) AS notice_version, row_number() OVER (PARTITION BY user_key ORDER BY date_trunc('day', ts) DESC, id DESC) AS rn
    FROM check_event) WHERE rn = 1""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    old = v.check_event.select(
        "user_key", F.concat(F.lit("v"), F.col("k") % 4).alias("notice_version"),
        F.date_trunc("day", "ts").alias("ts"), F.col("id").alias("discriminator"),
    )
    return EV.collapse_consent(old).select("user_key", "notice_version")


@query(
    "collapse_counters",
    """
    WITH o AS (SELECT user_key, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN k % 3 = 0 THEN 'web_ip:' ELSE 'face' END || lpad(CAST(id AS VARCHAR), 9, '0') AS d, k FROM check_event)
    SELECT user_key, CASE WHEN starts_with(d, 'web_ip:') THEN 'web_ip' ELSE 'user' END AS scope, day, arg_min(k, d) AS count FROM o GROUP BY ALL""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    face = F.concat(F.when(F.col("k") % 3 == 0, "web_ip:").otherwise("face"), F.lpad(F.col("id").cast("string"), 9, "0"))
    old = v.check_event.select("user_key", F.to_date("ts").alias("day"), face.alias("discriminator"), F.col("k").alias("count"))
    return EV.collapse_counters(old)


@query("backfill_next_action", "SELECT check_id, coalesce(next_action, 'not_sure') AS next_action FROM feedback", ("feedback",))
def _(v: Views) -> DataFrame:
    return EV.backfill_next_action(v.feedback).select("check_id", "next_action")


def _posts(v: Views) -> DataFrame:
    n = F.col("doc_id")
    both = {
        f"{part}_{lang}": c for lang in V.REPLY_LANGUAGES
        for part, c in (("title", F.concat(F.lit("Post "), n)), ("summary", F.col("source")), ("article", F.col("text")))
    }
    return v.table("documents").select(
        n.alias("id"), F.concat(F.when(n % 9 == 1, "Post--").otherwise("post-"), n).alias("slug"),
        F.when(n % 9 == 2, "other").otherwise(pick(n, V.POST_CATEGORIES)).alias("category"),
        F.when(n % 9 == 3, "gone").when(n % 4 == 0, "draft").otherwise("published").alias("state"),
        F.when(n % 5 != 0, F.timestamp_seconds(F.lit(1700000000) + (n * 7919) % 100003)).alias("published_ts"),
        *[F.when(n % 9 == 4, F.lit(" ")).otherwise(c).alias(name) if name == "title_ru" else c.alias(name) for name, c in both.items()],
    )


@query(
    "published_posts",
    r"""
    SELECT doc_id AS id, 'Post ' || doc_id AS title, CAST(greatest(1, round_even(len(regexp_extract_all(text, '\S+')) / 180, 0)) AS BIGINT) AS reading_minutes FROM documents
    WHERE doc_id % 9 NOT IN (3) AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 ORDER BY (doc_id * 7919) % 100003 DESC, doc_id LIMIT 20""",
)
def _(v: Views) -> DataFrame:
    shown = EV.published_posts(_posts(v).withColumn("title_uz_latn", F.concat(F.lit("Post "), "id")), "uz_latn", 20)
    return shown.select("id", "title", "reading_minutes")


@query(
    "validate_posts",
    r"""
    SELECT doc_id AS id, CASE WHEN doc_id % 9 = 1 THEN 'invalid_slug' WHEN doc_id % 9 = 2 THEN 'invalid_category' WHEN doc_id % 9 = 3 THEN 'invalid_state'
      WHEN doc_id % 9 = 4 THEN 'invalid_title' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) NOT BETWEEN 1 AND 12000 THEN 'invalid_article' END AS reason FROM documents""",
)
def _(v: Views) -> DataFrame:
    parts = EV.validate_posts(_posts(v))
    none = F.lit(None).cast("string").alias("reason")
    return parts["valid"].select("id", none).unionByName(parts["quarantine"].select("id", "reason"))


@query(
    "validate_log_events",
    """
    SELECT id, CASE WHEN k % 12 = 1 THEN 'unknown_event' WHEN k % 12 = 2 THEN 'unknown_field' WHEN k % 12 = 3 THEN 'unknown_field' WHEN k % 12 = 4 THEN 'content_like_value'
      WHEN k % 12 = 5 THEN 'content_like_value' WHEN k % 12 = 6 THEN 'unknown_stage' END AS reason FROM check_event""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    k = F.col("k")
    fields = (
        F.when(k % 12 == 2, '{"city": "x"}')
        .when(k % 12 == 3, '{"raw_text": "x"}')
        .when(k % 12 == 4, '{"status": "ann@mail.example"}')
        .when(k % 12 == 5, '{"kb_version": "not a version"}')
        .when(k % 12 == 6, '{"attempt": "1"}')
        .when(k % 12 == 7, '{"attempt": "1", "timeout_s": "30"}')
        .otherwise(F.to_json(F.struct("status", F.lit("2026-07-15-v1").alias("kb_version"), F.lit("3").alias("active_cards"))))
    )
    logged = v.check_event.select(
        "id", F.when(k % 12 == 1, "made_up").when(k % 12 < 6, "check_started").otherwise("check_failed").alias("name"),
        F.when(k % 12 == 6, "attic").when(k % 12 == 7, "llm").alias("stage"), fields.alias("fields"),
    )
    parts = EV.validate_log_events(logged)
    none = F.lit(None).cast("string").alias("reason")
    return parts["valid"].select("id", none).unionByName(parts["quarantine"].select("id", "reason"))


# --- M: metrics -------------------------------------------------------------------------------------

_TOTALS_SQL = f"""count(*) AS checks_total, count(*) FILTER ({_DONE}) AS checks_completed, count(*) FILTER (NOT {_DONE}) AS checks_failed,
    round(CAST(count(*) FILTER ({_DONE}) AS DOUBLE) / count(*), 4) AS completion_rate"""
_COST_SQL = f"""CAST(sum(cost_usd) AS DOUBLE) AS cost_total_usd, round(CAST(sum(cost_usd) FILTER ({_DONE}) AS DOUBLE) / count(*) FILTER ({_DONE}), 6) AS cost_avg_success_usd"""
_LATENCY_SQL = "round(avg(latency_ms), 2) AS latency_avg_ms"
_QUIET_SQL = f"count(*) FILTER (no_signal) AS no_signal_count, round(CAST(count(*) FILTER (no_signal) AS DOUBLE) / count(*) FILTER ({_DONE}), 4) AS no_signal_rate"
_KNOWLEDGE_SQL = """count(retrieval_status) AS knowledge_checks, count(*) FILTER (retrieval_status IS NOT NULL AND len(knowledge_card_ids) > 0) AS knowledge_selected,
    count(*) FILTER (retrieval_status = 'unavailable') AS knowledge_unavailable,
    round(CAST(count(*) FILTER (retrieval_status IS NOT NULL AND len(knowledge_card_ids) > 0) AS DOUBLE) / count(retrieval_status), 4) AS knowledge_coverage_rate,
    round(CAST(count(*) FILTER (retrieval_status = 'unavailable') AS DOUBLE) / count(retrieval_status), 4) AS knowledge_unavailable_rate"""


def _metric(name: str, build, columns: str) -> None:
    @query(name, f"SELECT {columns} FROM check_event WHERE {_WINDOW}", ("check_event",))
    def _(v: Views) -> DataFrame:
        return build(v.check_event, SINCE, UNTIL)


_metric("check_totals", M.check_totals, _TOTALS_SQL)
_metric("cost_summary", M.cost_summary, _COST_SQL)
_metric("latency_summary", M.latency_summary, _LATENCY_SQL)
_metric("no_signal_rate", M.no_signal_rate, _QUIET_SQL)
_metric("safety_blocked", M.safety_blocked, "count(*) FILTER (safety_blocked) AS safety_blocked")
_metric("knowledge_coverage", M.knowledge_coverage, _KNOWLEDGE_SQL)

_ACTIVATION_SQL = f"""
    SELECT c.n AS consented_users, a.n AS activated_users, round(CAST(a.n AS DOUBLE) / c.n, 4) AS activation_rate
    FROM (SELECT count(DISTINCT user_key) AS n FROM consent) c, (SELECT count(DISTINCT user_key) AS n FROM check_event WHERE {_DONE}) a"""


@query("activation", _ACTIVATION_SQL, ("check_event", "consent"))
def _(v: Views) -> DataFrame:
    return M.activation(v.check_event, v.consent)


@query(
    "breakdown",
    f"""SELECT 'status' AS dimension, status AS value, count(*) AS checks FROM check_event WHERE {_WINDOW} GROUP BY status
    UNION ALL SELECT 'language', language, count(*) FROM check_event WHERE {_WINDOW} GROUP BY language""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return M.breakdown(v.check_event, ["status", "language"], SINCE, UNTIL)


@query(
    "feedback_breakdown",
    f"SELECT next_action AS value, count(*) AS responses FROM feedback WHERE {_WINDOW} AND next_action IS NOT NULL GROUP BY ALL",
    ("feedback",),
)
def _(v: Views) -> DataFrame:
    return M.feedback_breakdown(v.feedback, v.check_event, "next_action", SINCE, UNTIL, exclude_null=True)


@query(
    "kb_inventory",
    "SELECT '2024-01-01-v1' AS version, count(*) FILTER (status = 'approved') AS approved_cards FROM model_cards",
    ("model_cards",),
)
def _(v: Views) -> DataFrame:
    return M.kb_inventory(v.model_cards, KB_VERSION)


def _map_text(column: str):
    pairs = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), ",").alias(column)


def _map_sql(column: str, table: str, where: str = "TRUE") -> str:
    return f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT {column} AS v, count(*) AS n FROM {table} WHERE {where} GROUP BY 1))"


@query(
    "collect_metrics",
    f"""
    SELECT *, (SELECT count(DISTINCT user_key) FROM consent WHERE {_WINDOW}) AS consented_users,
      coalesce(round(CAST(activated_users AS DOUBLE) / nullif((SELECT count(DISTINCT user_key) FROM consent WHERE {_WINDOW}), 0), 4), 0) AS activation_rate,
      {_map_sql('status', 'check_event', _WINDOW)} AS by_status, {_map_sql('language', 'check_event', _WINDOW)} AS by_language,
      {_map_sql('usefulness', 'feedback', _WINDOW)} AS usefulness, {_map_sql('next_action', 'feedback', _WINDOW + ' AND next_action IS NOT NULL')} AS next_action,
      '2024-01-01-v1' AS kb_version, (SELECT count(*) FROM model_cards WHERE status = 'approved') AS kb_approved_cards
    FROM (SELECT {_TOTALS_SQL}, count(DISTINCT user_key) FILTER ({_DONE}) AS activated_users, {_COST_SQL}, {_LATENCY_SQL}, {_QUIET_SQL},
            count(*) FILTER (safety_blocked) AS safety_blocked, {_KNOWLEDGE_SQL} FROM check_event WHERE {_WINDOW})""",
    ("check_event", "consent", "feedback", "model_cards"),
)
def _(v: Views) -> DataFrame:
    summary = M.collect_metrics(v.check_event, v.consent, v.feedback, v.model_cards, KB_VERSION, SINCE, UNTIL)
    maps = ("by_status", "by_language", "usefulness", "next_action")
    return summary.select(*[_map_text(c) if c in maps else F.col(c) for c in summary.columns])


_NUMBERS = [k for k in METRIC_KEYS if k != "kb_version"]


@query(
    "metrics_long",
    f"""
    WITH m AS (SELECT {_TOTALS_SQL}, count(DISTINCT user_key) FILTER ({_DONE}) AS activated_users, {_COST_SQL}, {_QUIET_SQL},
                 count(*) FILTER (safety_blocked) AS safety_blocked, {_KNOWLEDGE_SQL} FROM check_event),
         w AS (SELECT *, coalesce(round(CAST(activated_users AS DOUBLE) / nullif((SELECT count(DISTINCT user_key) FROM consent), 0), 4), 0) AS activation_rate,
                 (SELECT count(*) FROM model_cards WHERE status = 'approved') AS kb_approved_cards FROM m)
    SELECT 'kb_version' AS key, '2024-01-01-v1' AS value
    """
    + " ".join(f"UNION ALL SELECT '{k}', CAST(CAST({k} AS DECIMAL(18, 6)) AS VARCHAR) FROM w" for k in _NUMBERS),
    ("check_event", "consent", "model_cards"),
)
def _(v: Views) -> DataFrame:
    # Doubles print differently from engine to engine, so numbers are compared at six digits.
    summary = M.collect_metrics(v.check_event, v.consent, v.feedback, v.model_cards, KB_VERSION)
    exact = F.col("value").try_cast("decimal(18,6)").cast("string")
    return metrics_long(summary).select("key", F.when(F.col("key") != "kb_version", exact).otherwise(F.col("value")).alias("value"))


_LABELLED_SQL = """
    lab AS (SELECT f.check_id, rule_ids, usefulness, next_action FROM feedback f JOIN check_event e ON f.check_id = e.id),
    per AS (SELECT unnest(list_distinct(rule_ids)) AS rule_id, usefulness, next_action FROM lab),
    base AS (SELECT round(CAST(count(*) FILTER (usefulness IN ('yes', 'partly')) AS DOUBLE) / count(*), 4) AS r FROM lab)"""


@query(
    "rule_usefulness",
    f"""
    WITH {_LABELLED_SQL}, c AS (SELECT rule_id, count(*) AS responses, count(*) FILTER (usefulness IN ('yes', 'partly')) AS useful FROM per GROUP BY rule_id),
      r AS (SELECT *, round(CAST(useful AS DOUBLE) / responses, 4) AS useful_rate FROM c)
    SELECT r.rule_id, coalesce(family, 'unmapped') AS family, responses, useful, useful_rate, round(base.r - useful_rate, 4) AS gap_from_baseline,
      responses >= 5 AND round(base.r - useful_rate, 4) >= 0.15 AS candidate FROM r CROSS JOIN base LEFT JOIN model_rules m ON r.rule_id = m.rule_id""",
    ("check_event", "feedback", "model_rules"),
)
def _(v: Views) -> DataFrame:
    return labels.rule_usefulness(v.check_event, v.feedback, v.model_rules)


@query(
    "rule_next_actions",
    f"WITH {_LABELLED_SQL} SELECT rule_id, next_action, count(*) AS count FROM per WHERE next_action IS NOT NULL GROUP BY ALL",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    return labels.rule_next_actions(v.check_event, v.feedback)


@query(
    "next_action_counts",
    f"WITH {_LABELLED_SQL} SELECT next_action, count(*) AS count FROM lab WHERE next_action IS NOT NULL GROUP BY ALL",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    return labels.next_action_counts(labels.labelled_checks(v.check_event, v.feedback))


@query(
    "rule_action_maps",
    f"""WITH {_LABELLED_SQL}, c AS (SELECT rule_id, next_action, count(*) AS n FROM per WHERE next_action IS NOT NULL GROUP BY ALL)
    SELECT rule_id, string_agg(next_action || '=' || n, ',' ORDER BY next_action) AS next_actions FROM c GROUP BY rule_id""",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    return labels.rule_action_maps(v.check_event, v.feedback).select("rule_id", _map_text("next_actions"))


@query(
    "action_deltas",
    f"""
    WITH {_LABELLED_SQL}, o AS (SELECT next_action, count(*) AS n, sum(count(*)) OVER () AS t FROM lab WHERE next_action IS NOT NULL GROUP BY next_action),
      r AS (SELECT rule_id, next_action, count(*) AS n FROM per WHERE next_action IS NOT NULL GROUP BY ALL), t AS (SELECT rule_id, sum(n) AS t FROM r GROUP BY rule_id),
      ids AS (SELECT DISTINCT rule_id FROM per),
      g AS (SELECT ids.rule_id, o.next_action, coalesce(r.n, 0) AS count, CASE WHEN coalesce(t.t, 0) = 0 THEN 0 ELSE round(CAST(coalesce(r.n, 0) AS DOUBLE) / t.t, 4) END AS rule_rate,
              o.n AS overall_count, round(CAST(o.n AS DOUBLE) / o.t, 4) AS overall_rate
            FROM ids CROSS JOIN o LEFT JOIN r ON r.rule_id = ids.rule_id AND r.next_action = o.next_action LEFT JOIN t ON t.rule_id = ids.rule_id)
    SELECT *, round(rule_rate - overall_rate, 4) AS delta FROM g""",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    return labels.action_deltas(v.check_event, v.feedback)


@query(
    "gap_coverage",
    f"""
    SELECT language, count(*) AS checks, count(*) FILTER (len(knowledge_card_ids) > 0) AS found,
      round(CAST(count(*) FILTER (len(knowledge_card_ids) > 0) AS DOUBLE) / count(*), 8) AS coverage_rate,
      count(*) FILTER (len(knowledge_card_ids) = 0 AND retrieval_status <> 'unavailable') AS no_match,
      count(*) FILTER (len(knowledge_card_ids) = 0 AND retrieval_status = 'unavailable') AS unavailable
    FROM check_event WHERE retrieval_status IS NOT NULL AND {_WINDOW} GROUP BY language""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    found = gaps.gap_coverage(v.check_event, SINCE, UNTIL)
    return found.withColumn("coverage_rate", F.round("coverage_rate", 8))


@query(
    "gap_groups",
    """
    SELECT language, array_to_string(list_sort(rule_ids), ',') AS rule_ids, count(*) AS count FROM check_event e JOIN feedback f ON f.check_id = e.id
    WHERE retrieval_status = 'empty' AND usefulness = 'no' GROUP BY ALL""",
    ("check_event", "feedback"),
)
def _(v: Views) -> DataFrame:
    return gaps.gap_groups(v.check_event, v.feedback)


_USED_SQL = "used AS (SELECT card_id, count(*) AS n FROM (SELECT unnest(knowledge_card_ids) AS card_id FROM check_event WHERE retrieval_status IS NOT NULL) GROUP BY card_id)"


@query(
    "card_usage",
    f"WITH {_USED_SQL} SELECT coalesce(u.card_id, m.id) AS card_id, coalesce(n, 0) AS count FROM used u FULL JOIN (SELECT id FROM model_cards WHERE status = 'approved') m ON u.card_id = m.id",
    ("check_event", "model_cards"),
)
def _(v: Views) -> DataFrame:
    return gaps.card_usage(v.check_event, v.model_cards)


@query(
    "unused_cards",
    f"WITH {_USED_SQL} SELECT id AS card_id FROM model_cards WHERE status = 'approved' AND id NOT IN (SELECT card_id FROM used)",
    ("check_event", "model_cards"),
)
def _(v: Views) -> DataFrame:
    return gaps.unused_cards(v.check_event, v.model_cards)


@query(
    "router_health",
    """
    SELECT key, count(*) AS count FROM (SELECT 'mode:' || retrieval_mode AS key FROM check_event WHERE retrieval_status IS NOT NULL
      UNION ALL SELECT 'status:' || router_status FROM check_event WHERE retrieval_status IS NOT NULL AND router_status <> 'not_used') WHERE key IS NOT NULL GROUP BY key""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return gaps.router_health(v.check_event)


@query(
    "availability",
    """
    SELECT count(retrieval_status) AS checks, count(*) FILTER (retrieval_status = 'unavailable') AS unavailable,
      round(CAST(count(*) FILTER (retrieval_status = 'unavailable') AS DOUBLE) / count(retrieval_status), 8) AS rate,
      CAST(count(*) FILTER (retrieval_status = 'unavailable') AS DOUBLE) / count(retrieval_status) >= 0.05 AS alert
    FROM check_event WHERE ts >= TIMESTAMP '2024-01-15'""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return alerts.availability(v.check_event, "2024-01-15", 0.05).withColumn("rate", F.round("rate", 8))


_DEBOUNCE_SQL = f"""
    WITH e AS (SELECT DISTINCT stage, error_type, ts FROM errors WHERE stage IN ('ocr', 'llm', 'web', 'bot', 'knowledge', 'url_reputation')),
         sent AS (SELECT stage, error_type, min(ts) AS ts FROM e GROUP BY stage, error_type
                  UNION ALL SELECT s.stage, s.error_type, min(e.ts) FROM sent s JOIN e ON e.stage = s.stage AND e.error_type = s.error_type AND e.ts >= s.ts + INTERVAL 7200 SECOND GROUP BY s.stage, s.error_type, s.ts)
    SELECT stage, error_type, {stamp('ts')} AS ts FROM sent"""


@query("debounce_alerts", _DEBOUNCE_SQL, ("errors",), recursive=True)
def _(v: Views) -> DataFrame:
    return alerts.debounce_alerts(v.errors, debounce_seconds=7200, slice_seconds=86400)


_LIFECYCLE_SQL = """
    SELECT request_id, bool_or(event = 'check_started') AS has_start, min(event) FILTER (event IN ('check_completed', 'check_failed')) AS outcome,
      coalesce(array_to_string(list_sort(list(DISTINCT error_type) FILTER (error_type IS NOT NULL)), ','), '') AS error_types,
      date_diff('millisecond', min(ts) FILTER (event = 'check_started'), min(ts) FILTER (event IN ('check_completed', 'check_failed'))) AS duration_ms
    FROM log_events GROUP BY request_id"""


@query("lifecycle", _LIFECYCLE_SQL, ("log_events",))
def _(v: Views) -> DataFrame:
    return alerts.lifecycle(v.log_events)


# --- K: streams -------------------------------------------------------------------------------------


class StreamViews(Views):
    """The same views with ``events`` and ``documents`` read as streams, everything that is there."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        return read_table_stream(self.spark, self.path, "events[.]parquet", super().table(name).schema)


def _streamed(v: Views, build) -> DataFrame:
    """Runs a stream over the events to its end and reads back what it wrote."""
    folder = scratch_dir(v.spark)
    K.rocksdb_state(v.spark)
    K.run_available(build(StreamViews(v.spark, v.path)), f"{folder}/out", f"{folder}/checkpoint")
    return v.spark.read.parquet(f"{folder}/out")


_SIGNAL_ROWS_SQL = f"{BLOCK_ROWS_SQL}, sig AS ({STRUCTURAL_SQL})"


_SCREENED_SQL = f"""
    WITH {_SIGNAL_ROWS_SQL}
    SELECT msg_id, rule_id AS name, family AS note FROM rule_hits
    UNION ALL SELECT msg_id, kind, note FROM sig
    UNION ALL SELECT DISTINCT 'p' || page_id, rule_id, family FROM pages JOIN patterns ON contains({norm("url")}, needle)
    UNION ALL SELECT 'p' || page_id, 'shared.link.blocklisted', 'suspicious_link_qr' FROM pages
      WHERE sha256(regexp_replace(split_part(url, '/', 3), '^www\\.', '')) IN (SELECT domain_hash FROM block)"""


def _screened(v: Views, run) -> DataFrame:
    """Hits and signals of all corpus tables as streams; ``run`` screens a table's stream into a folder."""
    folder, found = scratch_dir(v.spark), None
    for table in ("documents", "conversations", "pages"):
        schema = v.spark.read.parquet(f"{v.path}/{table}.parquet").schema
        run(read_message_stream(v.spark, v.path, table, schema), f"{folder}/{table}", f"{folder}/{table}-checkpoint")
        screened = v.spark.read.parquet(f"{folder}/{table}")
        hits = screened.select("msg_id", F.explode("hits").alias("h")).select("msg_id", F.col("h.rule_id").alias("name"), F.col("h.family").alias("note"))
        if table != "pages":  # links have signals of their own, see sig_links
            signals = screened.select("msg_id", F.explode("signals").alias("s"))
            hits = hits.unionByName(signals.select("msg_id", F.col("s.kind").alias("name"), F.coalesce("s.note", F.lit("")).alias("note")))
        found = hits if found is None else found.unionByName(hits)
    return found


@query("screen_stream", _SCREENED_SQL, ("messages", "normal", "rule_hits"))
def _(v: Views) -> DataFrame:
    return _screened(
        v, lambda rows, path, checkpoint: K.screen_stream(rows, v.patterns, path, checkpoint, K.AVAILABLE, blocklist=v.blocklist).awaitTermination()
    )


@query("screened_stream", _SCREENED_SQL, ("messages", "normal", "rule_hits"))
def _(v: Views) -> DataFrame:
    return _screened(
        v, lambda rows, path, checkpoint: K.run_available(K.screened_stream(rows, v.patterns, blocklist=v.blocklist), path, checkpoint)
    )


# A window is emitted once the watermark, ten minutes behind the newest event, has passed its end.
@query(
    "availability_stream",
    f"""
    WITH w AS (SELECT unnest(range(0, 6)) AS i),
         x AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(5 * i AS INTEGER)) AS start, retrieval_status FROM check_event, w),
         a AS (SELECT start, count(retrieval_status) AS checks, count(*) FILTER (retrieval_status = 'unavailable') AS unavailable FROM x GROUP BY start)
    SELECT {stamp('start')} AS window_start, checks, unavailable, CASE WHEN checks = 0 THEN 0.0 ELSE round(CAST(unavailable AS DOUBLE) / checks, 8) END AS rate,
      unavailable > 0 AND CAST(unavailable AS DOUBLE) / checks >= 0.5 AS alert
    FROM a WHERE start + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM check_event)""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return _streamed(v, lambda s: K.availability_stream(s.check_event, 0.5)).withColumn("rate", F.round("rate", 8))


@query(
    "traffic_stream",
    f"""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS checks, count(*) FILTER ({_DONE}) AS completed FROM check_event
    GROUP BY ALL HAVING CAST(any_value(ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM check_event)""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return _streamed(v, lambda s: K.traffic_stream(s.check_event))


@query(
    "traffic_windows",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS checks, count(*) FILTER ({_DONE}) AS completed FROM check_event GROUP BY ALL",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return alerts.traffic_windows(v.check_event)


_SESSIONS_SQL = """
    WITH g AS (SELECT user_key, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM check_event WINDOW w AS (PARTITION BY user_key ORDER BY ts)),
         s AS (SELECT *, sum(opens) OVER (PARTITION BY user_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
         r AS (SELECT user_key, min(ts) AS a, max(ts) AS b, count(*) AS events FROM s GROUP BY user_key, n)"""
_SESSION_ROWS = f"SELECT user_key, {stamp('a')} AS session_start, {stamp('b')} AS session_end, events FROM r"


@query("user_sessions", f"{_SESSIONS_SQL} {_SESSION_ROWS}", ("check_event",))
def _(v: Views) -> DataFrame:
    return alerts.user_sessions(v.check_event)


@query(
    "session_stream",
    f"{_SESSIONS_SQL} {_SESSION_ROWS} WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM check_event)",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return _streamed(v, lambda s: K.session_stream(s.check_event))


@query("debounce_stream", _DEBOUNCE_SQL, ("errors",), recursive=True)
def _(v: Views) -> DataFrame:
    return _streamed(v, lambda s: K.debounce_stream(s.errors, debounce_seconds=7200))


@query("quota_stream", _ADMIT_SQL + "check_event", ("check_event",))
def _(v: Views) -> DataFrame:
    return _streamed(v, lambda s: K.quota_stream(s.check_event, limit=2))


@query("blocklist_stream", BLOCK_UPSERT_SQL)
def _(v: Views) -> DataFrame:
    folder = scratch_dir(v.spark)
    pages = read_table_stream(v.spark, v.path, "pages[.]parquet", v.table("pages").schema)
    now = F.lit(FEED_TIME).cast("timestamp")
    K.blocklist_stream(feed_hashes(pages), v.blocklist, folder, f"{folder}/checkpoint", now, K.AVAILABLE).awaitTermination()
    return v.spark.read.parquet(f"{folder}/list").select("domain_hash", "source", "first_seen", "last_seen")


@query(
    "lifecycle_stream",
    _LIFECYCLE_SQL + " HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM log_events)",
    ("log_events",),
)
def _(v: Views) -> DataFrame:
    return _streamed(v, lambda s: K.lifecycle_stream(s.log_events))
