"""SQL text shared by the oracle queries: the same views over the corpus tables, in DuckDB's dialect."""

from __future__ import annotations

from wardline.plans.phrases import PHRASES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def re2(pattern: str) -> str:
    """A pattern for an engine without lookaround: boundaries are consumed instead."""
    p = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    p = p.replace(r"(?<!\d)", r"(?:^|[^0-9])").replace(r"(?!\d)", r"(?:$|[^0-9])")
    p = p.replace(r"(?<!\w)", r"(?:^|[^\p{L}\p{N}_])").replace(r"(?<![a-z0-9])", r"(?:^|[^a-zA-Z0-9])")
    p = p.replace(r"(?![a-z0-9])", r"(?:$|[^a-zA-Z0-9])").replace(r"(?!\w)", r"(?:$|[^\p{L}\p{N}_])")
    p = p.replace("\\u0080", r"\x{80}").replace("\\uffff", r"\x{ffff}")
    return p.replace(r"\w", r"[\p{L}\p{N}_]")


def edge(pattern: str) -> str:
    """The pattern with Unicode word boundaries around it instead of ``\\b``."""
    flags = "(?i)" if pattern.startswith(("(?i)", "(?iU)")) else ""
    body = re2(pattern).removeprefix("(?i)")
    before = after = ""
    if body.startswith(r"\b"):
        body, before = body[2:], r"(?:^|[^\p{L}\p{N}_])"
    if body.endswith(r"\b"):
        body, after = body[:-2], r"(?:$|[^\p{L}\p{N}_])"
    return f"{flags}{before}(?:{body.replace(chr(92) + 'b', '')}){after}"


def any_match(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted(edge(p))})" for p in patterns) + ")"


def norm(column: str) -> str:
    """Matching form of corpus text: these tables hold no other characters that need folding."""
    return (
        f"trim(regexp_replace(replace(translate(lower({column}), '’‘`´', ''''''''''), 'ß', 'ss'), "
        r"'\s+', ' ', 'g'))"
    )


def choose(number: str, values) -> str:
    return f"({listed(values)})[({number}) % {len(values)} + 1]"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def sentence_list(column: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({column}, '[.\\n]+'), lambda s: trim(s, ' ')), "
        "lambda s: s <> '')"
    )


def dealt_list(column: str, place: int) -> str:
    """Every fourth entry from ``place`` (from 0) on."""
    return f"list_filter({column}, lambda x, i: i % 4 = {(place + 1) % 4})"


VIEWS = {
    "messages": """
        SELECT 'd' || doc_id AS msg_id, lang AS language, text FROM documents
        UNION ALL
        SELECT 'c' || conv_id || ':' || turn, NULL, text FROM conversations""",
    "normal": f"SELECT msg_id, text, {norm('text')} AS normalized FROM messages",
    "rules": f"""
        SELECT * FROM (
          SELECT item_id AS rule_order, 'bench.item_' || item_id AS rule_id,
                 'family_' || (item_id % 5) AS family, 'key_' || item_id AS message_key,
                 CAST(item_id % 3 + 1 AS BIGINT) AS severity,
                 CASE WHEN item_id % 2 = 0 THEN 'bench_even' END AS emits_signal,
                 list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS literals
          FROM benchmark)
        WHERE len(literals) > 0""",
    "patterns": f"""
        SELECT r.*, pos - 1 AS position, literals[pos] AS pattern, {norm('literals[pos]')} AS needle
        FROM (SELECT *, unnest(range(1, len(literals) + 1)) AS pos FROM rules) r""",
    "rule_hits": """
        SELECT DISTINCT n.msg_id, p.rule_order, p.rule_id, p.family, p.message_key, p.severity, p.emits_signal
        FROM normal n JOIN patterns p ON contains(n.normalized, p.needle)""",
    "cards": f"""
        SELECT 'card.item_' || item_id AS id, item_id,
               CASE WHEN item_id % 7 = 6 THEN 'draft' ELSE 'approved' END AS status,
               'bench.item_' || item_id AS trigger_rule_id,
               CASE WHEN item_id % 4 = 0 THEN
                 {choose('item_id // 4', ('email', 'phone', 'card', 'code', 'card_personal'))} END AS trigger_kind,
               list_filter(regexp_split_to_array(text, '[\\s.,]+'), lambda w: length(w) >= 9) AS aliases
        FROM benchmark""",
    "links": """
        SELECT page_id AS msg_id, url, split_part(url, '/', 3) AS host,
          CASE page_id % 8
            WHEN 0 THEN url
            WHEN 1 THEN 'hxxps://' || replace(split_part(url, '/', 3), '.', '[.]') || '/a'
            WHEN 2 THEN 'https://click.uz@' || split_part(url, '/', 3) || '/pay'
            WHEN 3 THEN 'http://192.0.2.' || (page_id % 250) || '/login'
            WHEN 4 THEN 'bit.ly/p' || page_id
            WHEN 5 THEN 'https://click.uz.' || split_part(url, '/', 3)
            WHEN 6 THEN 'www.paymee-' || page_id || '.example'
            ELSE 'https://th' || 'е' || 'st.' || split_part(url, '/', 3) || '/x' END AS raw_url
        FROM pages""",
    "link_messages": """
        SELECT msg_id, 'See ' || raw_url || ', then ' || url || ' or write to help@' || host || '.' AS text,
               raw_url, url, host FROM links""",
    "check_event": f"""
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_key, ts, k,
          CASE WHEN k % 6 = 0 THEN 'image' ELSE 'text' END AS input_type,
          CASE WHEN user_id % 2 = 0 THEN 'ru' ELSE 'uz_latn' END AS language,
          CASE WHEN k % 13 = k % 7 THEN ['r' || (k % 13)] ELSE ['r' || (k % 13), 'r' || (k % 7)] END AS rule_ids,
          CASE WHEN k % 3 = 0 OR k % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['c' || (k % 10)] END AS knowledge_card_ids,
          CASE WHEN event_type = 'signup' THEN NULL WHEN k % 3 = 0 OR k % 10 = 0 THEN 'none'
               ELSE {choose('k', ('rule', 'signal', 'cue', 'router'))} END AS retrieval_mode,
          CASE WHEN event_type = 'signup' THEN NULL WHEN k % 10 = 0 THEN 'unavailable'
               WHEN k % 3 = 0 THEN 'empty' ELSE 'ok' END AS retrieval_status,
          CASE WHEN event_type = 'signup' THEN NULL
               ELSE {choose('k', ('ok', 'invalid_ids', 'unavailable', 'not_used', 'not_used'))} END AS router_status,
          '2024-01-01-v1' AS kb_version,
          CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'no_signal'
               WHEN 'error' THEN 'llm_error' WHEN 'signup' THEN 'safety_fallback' END AS status,
          event_type = 'click' AS no_signal, event_type = 'signup' AS safety_blocked,
          CASE WHEN event_type = 'error' THEN 'TimeoutError' END AS error_class,
          CAST(floor(value * 10) AS INTEGER) AS latency_ms, k * 7 AS input_tokens, k * 3 AS output_tokens,
          CAST(k / 100000 AS DECIMAL(10, 6)) AS cost_usd
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
    "feedback": f"""
        SELECT id AS check_id, {choose('k // 3', ('yes', 'partly', 'no'))} AS usefulness,
          CASE WHEN k % 5 <> 4 THEN
            {choose('k', ('verify', 'delay_stop', 'continue', 'not_sure', 'verify'))} END AS next_action,
          ts + INTERVAL 1 HOUR AS ts
        FROM check_event WHERE status IN ('ok', 'no_signal')""",
    "consent": """
        SELECT user_key, CASE WHEN CAST(user_key AS BIGINT) % 5 = 0 THEN 'v1' ELSE 'v2' END AS notice_version,
          CASE WHEN CAST(user_key AS BIGINT) % 2 = 0 THEN 'ru' ELSE 'uz_latn' END AS language, min(ts) AS ts
        FROM check_event GROUP BY user_key""",
    "model_rules": """
        SELECT rule_id, 'family_' || (CAST(substr(rule_id, 2) AS INT) % 4) AS family,
               CAST(substr(rule_id, 2) AS INT) % 3 + 1 AS severity
        FROM (SELECT DISTINCT unnest(rule_ids) AS rule_id FROM check_event) WHERE rule_id <> 'r12'""",
    "model_cards": """
        SELECT 'c' || n AS id, CASE WHEN n = 9 THEN 'draft' ELSE 'approved' END AS status
        FROM (SELECT DISTINCT k % 12 AS n FROM check_event)""",
    "errors": f"""
        SELECT {choose('k', ('ocr', 'qr', 'llm', 'validate', 'web', 'bot', 'knowledge', 'url_reputation'))} AS stage,
          CASE WHEN latency_ms < 100 THEN 'Timeout' ELSE 'ProviderError' END AS error_type, ts FROM check_event""",
    "log_events": """
        SELECT md5(CAST(id AS VARCHAR)) AS request_id, 'check_started' AS event, NULL AS error_type, ts
        FROM check_event WHERE k % 9 <> 0
        UNION ALL
        SELECT md5(CAST(id AS VARCHAR)), 'app_error', 'TimeoutError', ts + to_milliseconds(latency_ms)
        FROM check_event WHERE status = 'llm_error'
        UNION ALL
        SELECT md5(CAST(id AS VARCHAR)),
          CASE WHEN status IN ('ok', 'no_signal') THEN 'check_completed' ELSE 'check_failed' END, NULL,
          ts + to_milliseconds(latency_ms)
        FROM check_event WHERE k % 11 <> 0""",
    "drafts": f"""
        SELECT conv_id || ':' || turn AS check_id, conv_id, n,
          CASE WHEN n % 2 = 0 THEN 'ru' ELSE 'uz_latn' END AS language,
          {dealt_list('s', 0)}[1:3] AS red_flags, array_to_string({dealt_list('s', 1)}, '. ') || ' ' || {choose('n', PHRASES)} AS pattern,
          {dealt_list('s', 2)}[1:3] AS verify, {dealt_list('s', 3)}[1:3] AS ask, rule_id, severity, has_hit, has_list,
          CASE WHEN n % 3 = 0 THEN ['card.alpha'] ELSE CAST([] AS VARCHAR[]) END AS card_ids
        FROM (SELECT *, 'fs.rule_' || (n % 6) AS rule_id, n % 3 + 1 AS severity, n % 4 <> 0 AS has_hit,
                     n % 4 <> 0 AND n % 7 = 0 AS has_list
              FROM (SELECT conv_id, turn, conv_id * 31 + turn AS n, {sentence_list('text')} AS s
                    FROM conversations WHERE role = 'assistant'))""",
    "draft_text": """
        SELECT *, trim(regexp_replace(array_to_string(list_filter(
          list_concat(list_concat(red_flags, [trim(pattern, ' ')]), list_concat(verify, ask)), lambda p: p <> ''), chr(10)),
          '[*~`]+', '', 'g')) AS scan FROM drafts""",
}

_NEEDS = {
    "normal": ("messages",), "patterns": ("rules",), "rule_hits": ("messages", "normal", "rules", "patterns"),
    "link_messages": ("links",), "feedback": ("check_event",), "consent": ("check_event",),
    "model_rules": ("check_event",), "model_cards": ("check_event",), "errors": ("check_event",),
    "log_events": ("check_event",), "draft_text": ("drafts",),
}


def with_views(names: tuple[str, ...], body: str, recursive: bool = False) -> str:
    """``body`` behind the named views and whatever those need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body, glue = body[5:], ",\n" if ctes else ""
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{glue}{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}" if ctes else body
