"""Registered queries: retrieval of cards, draft checks, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline import draft_values as D
from wardline.operators import drafts as DQ, evals, retrieval as RT
from wardline.plans.oracle_sql import any_match, dealt_list, edge, norm, quoted, re2
from wardline.plans.registry import query
from wardline.plans.views import Views, dealt, pick, sentences, strings

# --- F: cards ---------------------------------------------------------------------------------------

_SIGNAL_KINDS_SQL = """
    kinds AS (SELECT msg_id, 'email' AS kind FROM messages WHERE contains(text, '@') AND length(text) % 2 = 0
              UNION ALL SELECT msg_id, 'card' FROM messages WHERE regexp_matches(text, '[0-9]{13}'))"""
_MANDATORY_SQL = f"""
    {_SIGNAL_KINDS_SQL},
    mand AS (SELECT msg_id, id AS card_id, bool_or(by_rule) AS by_rule FROM (
               SELECT h.msg_id, c.id, TRUE AS by_rule FROM rule_hits h JOIN cards c ON c.trigger_rule_id = h.rule_id WHERE c.status = 'approved'
               UNION ALL SELECT k.msg_id, c.id, FALSE FROM kinds k JOIN cards c ON c.trigger_kind = k.kind WHERE c.status = 'approved') GROUP BY ALL)"""
_CUES_SQL = f"""
    alias AS (SELECT DISTINCT id, {norm('a')} AS a FROM (SELECT id, unnest(aliases) AS a FROM cards WHERE status = 'approved')),
    cues AS (SELECT msg_id, id AS card_id, count(*) AS score FROM normal JOIN alias ON contains(normalized, a) GROUP BY ALL)"""
_RANK_SQL = """
    pool AS (SELECT msg_id, card_id, max(m) AS m, bool_or(by_rule) AS by_rule, max(score) AS score FROM (
               SELECT msg_id, card_id, 1 AS m, by_rule, 0 AS score FROM mand UNION ALL SELECT msg_id, card_id, 0, FALSE, score FROM cues) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY m DESC, score DESC, card_id) AS rn FROM pool),
    picked AS (SELECT msg_id, list(card_id ORDER BY rn) FILTER (rn <= 3) AS card_ids, max(m) = 1 AS has_mandatory, bool_or(by_rule) AS rule_triggered
               FROM ranked GROUP BY msg_id)"""
_ALL_SQL = f"WITH {_MANDATORY_SQL}, {_CUES_SQL}, {_RANK_SQL}"
_MODE_SQL = """CASE WHEN has_mandatory AND rule_triggered THEN 'rule' WHEN has_mandatory THEN 'signal' WHEN card_ids IS NOT NULL THEN 'cue' ELSE 'none' END"""
_CARD_VIEWS = ("messages", "normal", "rule_hits", "cards")


def _kinds(v: Views) -> DataFrame:
    """Messages with hits, the text as its own redacted form, and two kinds of signal."""
    signal_type = "array<struct<kind:string,note:string>>"
    text, none = F.col("text"), F.lit(None).cast("string").alias("note")
    signals = F.array_compact(
        F.array(
            F.when(text.contains("@") & (F.length(text) % 2 == 0), F.struct(F.lit("email").alias("kind"), none)),
            F.when(text.rlike("[0-9]{13}"), F.struct(F.lit("card").alias("kind"), none)),
        )
    )
    return v.matched.select("msg_id", "hits", signals.cast(signal_type).alias("signals"), text.alias("minimized"))


def _exploded(v: Views) -> tuple[DataFrame, DataFrame]:
    kinds = _kinds(v)
    hits = kinds.select("msg_id", F.explode_outer("hits").alias("h")).filter("h is not null").select("msg_id", "h.rule_id")
    signals = kinds.select("msg_id", F.explode_outer("signals").alias("s")).filter("s is not null").select("msg_id", "s.kind")
    return hits, signals


@query(
    "load_cards",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN 'invalid_id' WHEN p_partkey % 10 = 2 THEN 'duplicate_id' WHEN p_partkey % 10 = 3 THEN 'invalid_version'
      WHEN p_partkey % 10 = 4 THEN 'no_reviewer' WHEN p_partkey % 10 = 5 THEN 'incomplete' WHEN p_partkey % 10 = 6 THEN 'invalid_linked_id' END AS reason
    FROM part WHERE p_partkey % 10 <> 7""",
)
def _(v: Views) -> DataFrame:
    n = F.col("p_partkey")
    bad = lambda digit, broken, sound: F.when(n % 10 == digit, broken).otherwise(sound)
    cards = v.table("part").select(
        n,
        F.when(n % 10 == 1, F.concat(F.lit("Part "), n)).when(n % 10 == 2, F.lit("part.same"))
        .otherwise(F.concat(F.lit("part.p"), n)).alias("id"),
        bad(3, F.lit("-1"), F.lit("1.0")).alias("version"),
        bad(7, F.lit("draft"), F.lit("approved")).alias("status"),
        bad(4, F.lit("  "), F.lit("someone")).alias("reviewer"),
        F.col("p_name").alias("mechanism"),
        bad(5, strings(), strings("step")).alias("verify_steps"),
        strings("ask").alias("questions"),
        bad(6, strings("Not An Id"), strings("fs.rule")).alias("trigger_rule_ids"),
        strings().alias("reviewed_case_ids"),
    )
    parts = RT.load_cards(cards)
    none = F.lit(None).cast("string").alias("reason")
    return parts["approved"].select("p_partkey", none).unionByName(parts["quarantine"].select("p_partkey", "reason"))


@query("mandatory_cards", f"WITH {_MANDATORY_SQL} SELECT * FROM mand", _CARD_VIEWS)
def _(v: Views) -> DataFrame:
    return RT.mandatory_cards(*_exploded(v), v.approved_cards)


@query("cue_scores", f"WITH {_CUES_SQL} SELECT * FROM cues", ("normal", "cards"))
def _(v: Views) -> DataFrame:
    texts = v.messages.select("msg_id", F.col("text").alias("minimized"))
    return RT.cue_scores(texts, RT.card_aliases(v.approved_cards))


@query("rank_cards", f"{_ALL_SQL} SELECT msg_id, array_to_string(card_ids, ',') AS card_ids FROM picked", _CARD_VIEWS)
def _(v: Views) -> DataFrame:
    hits, signals = _exploded(v)
    texts = v.messages.select("msg_id", F.col("text").alias("minimized"))
    cues = RT.cue_scores(texts, RT.card_aliases(v.approved_cards))
    return RT.rank_cards(RT.mandatory_cards(hits, signals, v.approved_cards), cues).select("msg_id", "card_ids")


@query(
    "retrieval_mode_status",
    f"{_ALL_SQL} SELECT msg_id, {_MODE_SQL} AS retrieval_mode, CASE WHEN card_ids IS NULL THEN 'empty' ELSE 'ok' END AS retrieval_status FROM messages LEFT JOIN picked USING (msg_id)",
    _CARD_VIEWS,
)
def _(v: Views) -> DataFrame:
    return RT.retrieve(_kinds(v), v.approved_cards, inline_limit=0).select("msg_id", "retrieval_mode", "retrieval_status")


@query(
    "retrieve",
    f"""{_ALL_SQL}
    SELECT msg_id, coalesce(array_to_string(card_ids, ','), '') AS card_ids, {_MODE_SQL} AS retrieval_mode,
      CASE WHEN card_ids IS NULL THEN '' ELSE 'case.shared,' || array_to_string(list_transform(card_ids, lambda c: replace(c, 'card.', 'case.')), ',') END AS reviewed_case_ids
    FROM messages LEFT JOIN picked USING (msg_id)""",
    _CARD_VIEWS,
)
def _(v: Views) -> DataFrame:
    return RT.retrieve(_kinds(v), v.approved_cards).select("msg_id", "card_ids", "retrieval_mode", "reviewed_case_ids")


@query(
    "apply_router",
    """
    WITH sel AS (SELECT id, retrieval_status FROM check_event WHERE retrieval_status IS NOT NULL),
         prop AS (SELECT id, k % 4 = 3 AS failed, ['c' || (k % 14), 'x' || k, 'c' || (k % 5), 'c' || (k % 5), 'c7', 'c8'] AS ids FROM check_event),
         named AS (SELECT id FROM model_cards),
         j AS (SELECT s.id, s.retrieval_status, p.failed, list_filter(p.ids, lambda i: i IN ('c0','c1','c2','c3','c4','c5','c6','c7','c8','c9','c10','c11')) AS good,
                      s.retrieval_status = 'empty' AND p.id IS NOT NULL AS asked FROM sel s LEFT JOIN prop p ON s.id = p.id)
    SELECT id, CASE WHEN NOT asked THEN 'not_used' WHEN failed THEN 'unavailable' ELSE 'invalid_ids' END AS router_status,
      CASE WHEN asked AND NOT failed THEN 'ok' ELSE retrieval_status END AS status,
      CASE WHEN asked AND NOT failed THEN array_to_string(list_filter(good, lambda g, i: list_position(good, g) = i)[1:3], ',') ELSE '' END AS card_ids
    FROM j""",
    ("check_event", "model_cards"),
)
def _(v: Views) -> DataFrame:
    ev, k = v.check_event, F.col("k")
    selected = ev.filter(F.col("retrieval_status").isNotNull()).select(
        "id", strings().alias("card_ids"), F.lit("none").alias("retrieval_mode"), "retrieval_status"
    )
    ids = F.array(
        F.concat(F.lit("c"), k % 14), F.concat(F.lit("x"), k), F.concat(F.lit("c"), k % 5), F.concat(F.lit("c"), k % 5),
        F.lit("c7"), F.lit("c8"),
    )
    proposals = ev.select(
        "id", ids.alias("card_ids"), (k % 4 == 3).alias("failed"), F.lit(5).alias("input_tokens"), F.lit(1).alias("output_tokens")
    )
    routed = RT.apply_router(selected, proposals, v.model_cards, id_col="id")
    return routed.select("id", "router_status", F.col("retrieval_status").alias("status"), "card_ids")


_CARD_MERGE_SQL = """
    base AS (SELECT 'p' || p_partkey AS id, p_name AS mechanism FROM part),
    over AS (SELECT CASE WHEN s_suppkey % 3 = 2 THEN 's' ELSE 'p' END || s_suppkey AS id, s_name AS mechanism,
                    ['approved', 'retired', 'approved'][s_suppkey % 3 + 1] AS status FROM supplier)"""


@query(
    "merge_cards",
    f"""WITH {_CARD_MERGE_SQL}
    SELECT coalesce(b.id, o.id) AS id, coalesce(o.mechanism, b.mechanism) AS mechanism FROM base b FULL JOIN (SELECT * FROM over WHERE status = 'approved') o ON b.id = o.id
    WHERE coalesce(b.id, o.id) NOT IN (SELECT id FROM over WHERE status <> 'approved')""",
)
def _(v: Views) -> DataFrame:
    base = v.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("mechanism"), F.lit("approved").alias("status"))
    key = F.col("s_suppkey")
    over = v.table("supplier").select(
        F.concat(F.when(key % 3 == 2, "s").otherwise("p"), key).alias("id"), F.col("s_name").alias("mechanism"),
        pick(key, ("approved", "retired", "approved")).alias("status"), F.timestamp_seconds(key).alias("updated_ts"),
    )
    return RT.merge_cards(base, over).select("id", "mechanism")


@query(
    "validate_card_overrides",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 1 THEN 'invalid_card_id' WHEN p_partkey % 11 = 2 THEN 'invalid_status' WHEN p_partkey % 11 = 3 THEN 'invalid_mechanism'
      WHEN p_partkey % 11 = 4 THEN 'invalid_trigger_rule' WHEN p_partkey % 11 = 5 THEN 'invalid_alias_language' WHEN p_partkey % 11 = 6 THEN 'invalid_aliases'
      WHEN p_partkey % 11 = 7 THEN 'invalid_verify_steps' WHEN p_partkey % 11 = 8 THEN 'invalid_questions' END AS reason FROM part""",
)
def _(v: Views) -> DataFrame:
    n = F.col("p_partkey")
    bad = lambda digit, broken, sound: F.when(n % 11 == digit, broken).otherwise(sound)
    long = F.repeat(F.lit("z"), F.lit(601))
    aliases = F.when(n % 11 == 5, F.create_map(F.lit("en"), strings("word"))).when(
        n % 11 == 6, F.create_map(F.lit("ru"), F.array(F.left(long, F.lit(121))))
    )
    overrides = v.table("part").select(
        n, bad(1, F.concat(F.lit("part"), n), F.concat(F.lit(" Part.P"), n)).alias("id"), F.lit("1.0").alias("version"),
        bad(2, F.lit("live"), F.lit("approved")).alias("status"), F.lit("me").alias("reviewer"),
        bad(3, long, F.col("p_name")).alias("mechanism"),
        bad(4, strings("fs"), strings(" FS.rule ")).alias("trigger_rule_ids"), strings("email", "").alias("trigger_signal_kinds"),
        F.coalesce(aliases, F.create_map(F.lit("ru"), F.array("p_name"))).alias("retrieval_aliases"),
        strings("flag").alias("red_flags"), bad(7, F.array(F.left(long, F.lit(401))), strings("step")).alias("verify_steps"),
        bad(8, F.array_repeat(F.lit("q"), 13), strings("q")).alias("questions"), strings("case.one").alias("reviewed_case_ids"),
    )
    parts = RT.validate_card_overrides(overrides)
    none = F.lit(None).cast("string").alias("reason")
    return parts["valid"].select("p_partkey", none).unionByName(parts["quarantine"].select("p_partkey", "reason"))


@query("kb_version", "SELECT '2024-01-01-v1.db' || strftime(max(ts), '%Y%m%d%H%M%S') AS kb_version FROM check_event", ("check_event",))
def _(v: Views) -> DataFrame:
    return RT.kb_version("2024-01-01-v1", v.check_event.select(F.col("ts").alias("updated_ts")))


@query(
    "card_impact",
    f"""
    WITH {_MANDATORY_SQL}, {_CUES_SQL},
      trial AS (SELECT msg_id, card_id, by_rule, m, score FROM (SELECT msg_id, card_id, by_rule, 1 AS m, 0 AS score FROM mand UNION ALL SELECT msg_id, card_id, FALSE, 0, score FROM cues) WHERE card_id <> 'card.item_0'
                UNION ALL SELECT msg_id, 'card.item_0', FALSE, 1, 0 FROM kinds WHERE kind = 'card'
                UNION ALL SELECT msg_id, 'card.item_0', FALSE, 0, 1 FROM normal WHERE contains(normalized, 'token =')),
      pool AS (SELECT msg_id, card_id, max(m) AS m, bool_or(by_rule) AS by_rule, max(score) AS score FROM trial GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY m DESC, score DESC, card_id) AS rn FROM pool),
      picked AS (SELECT msg_id, list(card_id ORDER BY rn) FILTER (rn <= 3) AS card_ids, max(m) = 1 AS has_mandatory, bool_or(by_rule) AS rule_triggered FROM ranked GROUP BY msg_id)
    SELECT msg_id, {_MODE_SQL} AS retrieval_mode, array_to_string(list_filter(card_ids, lambda c: c <> 'card.item_0'), ',') AS other_card_ids
    FROM picked WHERE list_contains(card_ids, 'card.item_0')""",
    _CARD_VIEWS,
)
def _(v: Views) -> DataFrame:
    # The candidate is a new version of the first card: other triggers, another alias.
    candidate = v.cards.filter(F.col("id") == "card.item_0").withColumns(
        {
            "trigger_rule_ids": strings(), "trigger_signal_kinds": strings("card"), "status": F.lit("approved"),
            "retrieval_aliases": F.create_map(F.lit("uz_latn"), strings("token =")),
        }
    )
    return RT.card_impact(_kinds(v), v.approved_cards, candidate)


# --- G: draft checks --------------------------------------------------------------------------------

_BANNED_SQL = (
    "regexp_matches(lower(scan), "
    + quoted(r"(?:^|[^\p{L}\p{N}_-])(?:" + "|".join(w.lower() for w in D.BANNED_WORDS) + r")(?:$|[^\p{L}\p{N}_-])")
    + ")"
)
_PHONE_SCAN = "CASE WHEN has_list THEN regexp_replace(scan, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '[DATE]', 'g') ELSE scan END"
_CLAIMS = "(" + " OR ".join(f"regexp_matches(s, {quoted(edge(p))})" for p in D.PAYMENT_CONFIRMED) + ")"
_PAYMENT_SQL = (
    f"len(list_filter(regexp_split_to_array(scan, '[.!?\\n;]+'), lambda s: {_CLAIMS} AND NOT regexp_matches(s, {quoted(edge(D.PAYMENT_DISCLAIMER))}))) > 0"
)
_LOOKUPS = DQ.lookup_patterns()


def _m(pattern: str, column: str = "scan") -> str:
    return f"regexp_matches({column}, {quoted(edge(pattern))})"


_URL_SQL = (
    r"regexp_matches(scan, '(?i)(?:^|[^\p{L}\p{N}_])(?:(?:https?|hxxps?)://[^\s<>()]+|www\.[a-z0-9.-]+\.[a-z]{2,}"
    r"|(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(?:$|[^\p{L}\p{N}_]))')"
)
_TEXT_SQL = {
    D.REASON_BANNED_WORD: _BANNED_SQL,
    D.REASON_DIRECT_VERDICT: any_match("scan", D.DIRECT_VERDICTS),
    D.REASON_RISK_SCORE: any_match("scan", D.RISK_SCORES),
    D.REASON_CONTACT_OR_URL: f"({_URL_SQL} OR regexp_matches(scan, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'))",
    D.REASON_PHONE: _m(D.CONTACT_PHONE, _PHONE_SCAN),
    D.REASON_CARD: _m(r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"),
    D.REASON_PASSPORT: _m(r"(?iU)(?<![a-z0-9])(?:[a-z]{2}\s?\d{7})(?![a-z0-9])"),
    D.REASON_SECRET: f"({_m(D.LABELLED_OTP)} OR {_m(D.PASSWORD_VALUE)})",
    D.REASON_UNSAFE: any_match("scan", D.UNSAFE_INSTRUCTIONS),
    D.REASON_INTERNAL_ID: f"({_m(D.INTERNAL_ID)} OR len(list_filter(card_ids, lambda c: contains(lower(scan), c))) > 0)",
    D.REASON_PAYMENT: _PAYMENT_SQL,
    D.REASON_CASE_PROOF: any_match("scan", D.CASE_AS_PROOF),
    D.REASON_EXTERNAL_LOOKUP: any_match("scan", _LOOKUPS),
    D.REASON_BLOCKLIST: f"({_m(D.BLOCKLIST_CLAIM)} AND NOT has_list)",
}
_OTHER_SQL = {
    D.REASON_SCRIPT: "(language = 'uz_latn' AND regexp_matches(scan, '[\\x{400}-\\x{52f}]'))",
    D.REASON_VERIFY_EMPTY: "len(verify) = 0",
    D.REASON_ASK_EMPTY: "len(ask) = 0",
    D.REASON_RED_FLAGS_EMPTY: "(len(red_flags) = 0 AND (has_list OR (has_hit AND severity >= 2)))",
    D.REASON_UNKNOWN_RULES: "n % 13 = 0",
    D.REASON_MISSING_RULES: "(n % 13 <> 0 AND n % 11 = 0 AND (has_list OR (has_hit AND severity >= 2)))",
}
_REASON_SQL = "CASE " + " ".join(f"WHEN {c} THEN {quoted(r)}" for r, c in (_TEXT_SQL | _OTHER_SQL).items()) + " END"
_JUDGED_SQL = f"judged AS (SELECT check_id, language, n, {_REASON_SQL} AS reason, NOT has_hit AND len(red_flags) = 0 AS no_signal FROM draft_text)"


def _column(reason: str) -> str:
    import re

    return re.sub(r"[^a-z]+", "_", reason.lower())


@query(
    "draft_flags",
    "SELECT check_id, " + ", ".join(f"{c} AS {_column(r)}" for r, c in _TEXT_SQL.items()) + " FROM draft_text",
    ("draft_text",),
)
def _(v: Views) -> DataFrame:
    return DQ.draft_flags(v.drafts).select("check_id", *[_column(r) for r in _TEXT_SQL])


@query(
    "draft_qa", f"WITH {_JUDGED_SQL} SELECT check_id, reason, reason IS NULL AS ok, no_signal FROM judged", ("draft_text",)
)
def _(v: Views) -> DataFrame:
    return DQ.draft_qa(v.drafts).select("check_id", "reason", "ok", "no_signal")


def _check(name: str, reason: str) -> None:
    """One query per text check, so each can be looked at on its own."""
    sql = f"SELECT check_id, {_TEXT_SQL[reason]} AS found FROM draft_text"

    @query(name, sql, ("draft_text",))
    def _(v: Views) -> DataFrame:
        return DQ.draft_flags(v.drafts).select("check_id", F.col(_column(reason)).alias("found"))


_check("draft_banned_word", D.REASON_BANNED_WORD)
_check("draft_direct_verdict", D.REASON_DIRECT_VERDICT)
_check("draft_risk_score", D.REASON_RISK_SCORE)
_check("draft_contact_or_url", D.REASON_CONTACT_OR_URL)
_check("draft_phone", D.REASON_PHONE)
_check("draft_card", D.REASON_CARD)
_check("draft_passport", D.REASON_PASSPORT)
_check("draft_secret", D.REASON_SECRET)
_check("draft_unsafe_instruction", D.REASON_UNSAFE)
_check("draft_internal_id", D.REASON_INTERNAL_ID)
_check("draft_payment_confirmed", D.REASON_PAYMENT)
_check("draft_case_as_proof", D.REASON_CASE_PROOF)
_check("draft_external_lookup", D.REASON_EXTERNAL_LOOKUP)
_check("draft_blocklist_claim", D.REASON_BLOCKLIST)


@query(
    "draft_truncate",
    "SELECT check_id, len(red_flags) AS red_flags, len(verify) AS verify, len(ask) AS ask, NOT has_hit AND len(red_flags) = 0 AS no_signal FROM drafts",
    ("drafts",),
)
def _(v: Views) -> DataFrame:
    cut = DQ.truncate_drafts(v.drafts)
    return cut.select(
        "check_id", *[F.size(c).alias(c) for c in ("red_flags", "verify", "ask")],
        ((F.size("hits") == 0) & (F.size("red_flags") == 0)).alias("no_signal"),
    )


@query(
    "draft_structure",
    "SELECT check_id, " + ", ".join(f"{c} AS {_column(r)}" for r, c in _OTHER_SQL.items() if r != D.REASON_MISSING_RULES)
    + ", n % 11 = 0 AND n % 13 <> 0 AND (has_list OR (has_hit AND severity >= 2)) AS missing_addressed_rule_ids FROM draft_text",
    ("draft_text",),
)
def _(v: Views) -> DataFrame:
    # Each structural check alone: a draft is judged with all text removed but its own blocks kept.
    hits = F.transform("hits", lambda h: h.rule_id)
    grave = F.transform(F.filter("hits", lambda h: h.severity >= 2), lambda h: h.rule_id)
    scan = DQ.normalize_output(DQ.joined_text())
    return DQ.truncate_drafts(v.drafts).select(
        "check_id",
        ((F.col("language") == "uz_latn") & scan.rlike(D.CYRILLIC_LETTER)).alias(_column(D.REASON_SCRIPT)),
        (F.size("verify") == 0).alias(_column(D.REASON_VERIFY_EMPTY)),
        (F.size("ask") == 0).alias(_column(D.REASON_ASK_EMPTY)),
        ((F.size("red_flags") == 0) & (F.size(grave) > 0)).alias(_column(D.REASON_RED_FLAGS_EMPTY)),
        (F.size(F.array_except("addressed_rule_ids", hits)) > 0).alias(_column(D.REASON_UNKNOWN_RULES)),
        (F.size(F.array_except(grave, F.col("addressed_rule_ids"))) > 0).alias(_column(D.REASON_MISSING_RULES)),
    )


@query(
    "rejection_breakdown",
    f"WITH {_JUDGED_SQL} SELECT reason, language, count(*) AS drafts FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    ("draft_text",),
)
def _(v: Views) -> DataFrame:
    return DQ.rejection_breakdown(DQ.draft_qa(v.drafts))


@query(
    "resolve_attempts",
    """
    WITH a AS (SELECT id // 3 AS check_id, id % 3 + 1 AS attempt, status = 'ok' AS ok, CASE WHEN status <> 'ok' THEN status END AS reason, input_tokens AS i, output_tokens AS o
               FROM check_event),
         w AS (SELECT check_id, min(CASE WHEN ok THEN attempt END) AS winner, max(attempt) AS last FROM a WHERE attempt <= 2 GROUP BY check_id)
    SELECT w.check_id, CASE WHEN winner IS NULL THEN 'safety_fallback' ELSE 'ok' END AS outcome, winner,
      max(CASE WHEN winner IS NULL AND attempt = last THEN reason END) AS reason,
      CAST(sum(i) FILTER (attempt <= coalesce(winner, 2)) AS BIGINT) AS input_tokens, CAST(sum(o) FILTER (attempt <= coalesce(winner, 2)) AS BIGINT) AS output_tokens
    FROM w JOIN a USING (check_id) WHERE attempt <= 2 GROUP BY w.check_id, winner""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    attempts = v.check_event.select(
        F.floor(F.col("id") / 3).alias("check_id"), (F.col("id") % 3 + 1).alias("attempt"),
        (F.col("status") == "ok").alias("ok"), F.when(F.col("status") != "ok", F.col("status")).alias("reason"),
        "input_tokens", "output_tokens",
    )
    return DQ.resolve_attempts(attempts)


@query(
    "check_status",
    """
    SELECT id, CASE WHEN k % 17 = 1 THEN 'rate_limited' WHEN k % 17 = 2 THEN 'ocr_error' WHEN k % 17 = 3 THEN 'empty_input' WHEN k % 17 = 4 THEN 'meta'
      WHEN k % 17 = 5 THEN 'timeout' WHEN k % 17 IN (6, 7) AND k % 2 = 0 THEN 'off_topic' WHEN status = 'safety_fallback' THEN 'safety_fallback'
      WHEN k % 2 = 0 AND k % 3 = 0 THEN 'no_signal' ELSE 'ok' END AS status FROM check_event""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    k = F.col("k")
    stages = v.check_event.select(
        "id", (k % 17 == 1).alias("rate_limited"), F.when(k % 17 == 2, "ocr_error").alias("media_status"),
        F.when(k % 17 == 3, "empty_input").alias("length_status"), (k % 17 == 4).alias("is_meta"),
        F.when(k % 17 == 5, "timeout").alias("model_error"),
        F.when(F.col("k") % 17 >= 6, F.when(k % 17 <= 7, "off_topic")).alias("situation_type"),
        (k % 2).alias("rule_hit_count"), F.when(F.col("status") == "safety_fallback", "safety_fallback").otherwise("ok").alias("outcome"),
        (k % 3).alias("red_flag_count"),
    )
    return DQ.check_status(stages).select("id", "status")


@query(
    "billable",
    "SELECT status, status IN ('ok', 'no_signal', 'low_ocr', 'off_topic', 'safety_fallback') AS billable, count(*) AS checks FROM check_event GROUP BY ALL",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    return v.check_event.groupBy("status", DQ.billable(F.col("status")).alias("billable")).agg(F.count("*").alias("checks"))


@query(
    "token_cost",
    "SELECT id, CAST(round(CAST(input_tokens * (0.15 + k % 3) + output_tokens * 0.6 AS DECIMAL(20, 4)) / 1000000, 6) AS DOUBLE) AS cost_usd FROM check_event",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    used = v.check_event.withColumn("model", F.concat(F.lit("m"), F.col("k") % 3)).drop("cost_usd")
    rates = used.select("model", (F.col("k") % 3).alias("n")).distinct().select(
        "model", (F.lit(0.15) + F.col("n")).alias("in_rate_per_m"), F.lit(0.6).alias("out_rate_per_m")
    )
    return DQ.token_cost(used, rates).select("id", "cost_usd")


def _outputs(v: Views) -> DataFrame:
    """Raw model outputs: plain JSON, fenced, with prose around it, broken, and a list."""
    n = F.col("conv_id") * 31 + F.col("turn")
    draft = F.to_json(
        F.struct(
            dealt(F.col("s"), 0).alias("red_flags"), F.array_join(dealt(F.col("s"), 1), ". ").alias("pattern"),
            dealt(F.col("s"), 2).alias("verify"), dealt(F.col("s"), 3).alias("ask"),
        )
    )
    raw = (
        F.when(n % 5 == 0, draft)
        .when(n % 5 == 1, F.concat(F.lit("```json\n"), draft, F.lit("\n```")))
        .when(n % 5 == 2, F.concat(F.lit("Here it is: "), draft, F.lit(" - done")))
        .when(n % 5 == 3, F.concat(draft, F.lit("}")))
        .otherwise(F.lit("[1, 2]"))
    )
    return (
        v.table("conversations").filter(F.col("role") == "assistant")
        .select("conv_id", "turn", sentences(F.col("text")).alias("s"))
        .select(
            F.concat_ws(":", "conv_id", "turn").alias("answer_id"), pick(n, ("alpha", "beta", "gamma")).alias("provider"),
            F.when(n % 2 == 0, "ru").otherwise("uz_latn").alias("language"), (n % 4 == 0).alias("expects_no_signal"), raw.alias("raw"),
        )
    )


_OUTPUT_SQL = f"""
    o AS (SELECT conv_id || ':' || turn AS answer_id, n, n % 5 IN (0, 1, 2) AS json_ok, ['alpha', 'beta', 'gamma'][n % 3 + 1] AS provider, {dealt_list('s', 0)} AS flags, array_to_string({dealt_list('s', 1)}, '. ') AS pattern,
            {dealt_list('s', 2)} AS verify, {dealt_list('s', 3)} AS ask FROM (SELECT conv_id, turn, conv_id * 31 + turn AS n,
            list_filter(list_transform(regexp_split_to_array(text, '[.\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM conversations WHERE role = 'assistant'))"""


@query(
    "parse_drafts",
    f"""WITH {_OUTPUT_SQL}
    SELECT answer_id, json_ok, CASE WHEN json_ok THEN len(flags) ELSE 0 END AS red_flags, CASE WHEN json_ok THEN len(verify) ELSE 0 END AS verify,
      CASE WHEN json_ok THEN pattern END AS pattern, CAST(0 AS BIGINT) AS addressed FROM o""",
)
def _(v: Views) -> DataFrame:
    return evals.parse_drafts(_outputs(v)).select(
        "answer_id", "json_ok", F.size("red_flags").alias("red_flags"), F.size("verify").alias("verify"), "pattern",
        F.size("addressed_rule_ids").alias("addressed"),
    )


_LOW_SQL = "low"
for _negation in D.RUBRIC_NEGATIONS:
    _LOW_SQL = f"replace({_LOW_SQL}, {quoted(_negation)}, ' ')"
_RUBRIC_SQL = f"""{_OUTPUT_SQL},
    t AS (SELECT *, array_to_string(list_concat(list_concat(list_concat(flags, verify), ask), CASE WHEN pattern <> '' THEN [pattern] ELSE [] END), ' ') AS txt FROM o),
    l AS (SELECT *, lower(txt) AS low FROM t),
    r AS (SELECT answer_id, provider, json_ok, json_ok AND n % 2 = 1 AS lang_ok,
            json_ok AND NOT ({" OR ".join(f"contains({_LOW_SQL}, {quoted(w)})" for w in D.RUBRIC_VERDICT_WORDS)}) AS no_verdict,
            json_ok AND NOT (regexp_matches(txt, {quoted(edge(D.RUBRIC_PHONE))}) OR regexp_matches(txt, {quoted(re2(D.RUBRIC_URL))}) OR regexp_matches(txt, {quoted(edge(D.RUBRIC_CARD))})) AS no_raw_contact,
            json_ok AND (len(flags) > 0 OR n % 4 = 0) AS has_red_flags, json_ok AND len(verify) > 0 AND len(ask) > 0 AS has_verify_ask,
            json_ok AND len(flags) <= 3 AND len(verify) <= 3 AND len(ask) <= 3 AS length_ok FROM l),
    scored AS (SELECT *, CAST(json_ok AS BIGINT) + CAST(lang_ok AS BIGINT) + CAST(no_verdict AS BIGINT) + CAST(no_raw_contact AS BIGINT) + CAST(has_red_flags AS BIGINT)
            + CAST(has_verify_ask AS BIGINT) + CAST(length_ok AS BIGINT) AS total FROM r)"""


@query("eval_rubric", f"WITH {_RUBRIC_SQL} SELECT * EXCLUDE (provider) FROM scored")
def _(v: Views) -> DataFrame:
    return evals.eval_rubric(evals.parse_drafts(_outputs(v))).select("answer_id", *D.RUBRIC_KEYS, "total")


@query(
    "eval_leaderboard",
    f"WITH {_RUBRIC_SQL} SELECT provider, CAST(sum(total) AS BIGINT) AS points, count(*) * 7 AS max_points, count(*) FILTER (total < 7) AS failing_outputs FROM scored GROUP BY provider",
)
def _(v: Views) -> DataFrame:
    return evals.eval_leaderboard(evals.eval_rubric(evals.parse_drafts(_outputs(v))))


@query(
    "failing_fixtures",
    f"""WITH {_RUBRIC_SQL}, k AS (SELECT answer_id, provider, list_filter([{', '.join(f"CASE WHEN NOT {key} THEN '{key}' END" for key in D.RUBRIC_KEYS)}], lambda x: x IS NOT NULL) AS failing FROM scored)
    SELECT answer_id, provider, array_to_string(failing, ',') AS failing FROM k WHERE len(failing) > 0""",
)
def _(v: Views) -> DataFrame:
    return evals.failing_fixtures(evals.eval_rubric(evals.parse_drafts(_outputs(v))))


@query(
    "forbidden_leaks",
    """
    WITH a AS (SELECT conv_id AS fixture_id, turn AS answer_id, replace(lower(text), 'ß', 'ss') AS answer FROM conversations WHERE role = 'assistant'),
         p AS (SELECT DISTINCT conv_id AS fixture_id, phrase FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS phrase FROM conversations WHERE role = 'user') WHERE length(phrase) > 3)
    SELECT fixture_id, answer_id, phrase FROM a JOIN p USING (fixture_id) WHERE contains(answer, replace(lower(phrase), 'ß', 'ss'))""",
)
def _(v: Views) -> DataFrame:
    turns = v.table("conversations")
    answers = turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("fixture_id"), F.col("turn").alias("answer_id"), F.lit("ok").alias("status"), F.col("text").alias("answer")
    )
    words = F.explode(F.split("text", " ")).alias("w")
    fixtures = turns.filter(F.col("role") == "user").select(F.col("conv_id").alias("fixture_id"), words)
    phrases = fixtures.filter(F.length("w") > 3).distinct().select("fixture_id", F.array("w").alias("must_not_contain"))
    return evals.forbidden_leaks(answers, phrases)
