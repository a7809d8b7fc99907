"""Registered queries: sources, text, rules, links, signals and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions import links as L, redact as R, signals as S, text as X
from wardline.operators import linkage, rules as RU, triage
from wardline.plans.oracle_sql import edge, norm, quoted, re2, stamp
from wardline.plans.registry import query
from wardline.plans.screening import screen
from wardline.plans.views import Views, pick, strings
from wardline.sources import refdata

# --- A: sources -----------------------------------------------------------------------------------


@query("read_messages", "SELECT msg_id, language, length(text) AS n_chars FROM messages", ("messages",))
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", "language", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "flatten_rules",
    "SELECT rule_order, rule_id, family, severity, 'uz_latn' AS language, position, pattern, needle FROM patterns",
    ("patterns",),
)
def _(v: Views) -> DataFrame:
    return v.patterns.select(
        "rule_order", "rule_id", "family", "severity", "language", "position", "pattern", "needle"
    )


# --- B: text ----------------------------------------------------------------------------------------


@query("normalize_text", "SELECT msg_id, md5(normalized) AS digest FROM normal", ("normal",))
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


@query(
    "normalize_output",
    "SELECT page_id, md5(regexp_replace(html, '[*~`]+', '', 'g')) AS digest FROM pages",
)
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.md5(X.normalize_output(F.col("html"))).alias("digest"))


@query(
    "assemble_content",
    r"""
    WITH t AS (SELECT conv_id, turn, [trim(regexp_replace(text, '^\s+|\s+$', '', 'g')), trim(role),
                 trim(regexp_replace(split_part(text, '.', 1), '^\s+|\s+$', '', 'g')), trim(role)] AS p FROM conversations),
         u AS (SELECT conv_id, turn, p, list_filter(range(1, 5), lambda i: p[i] <> '' AND NOT list_contains(p[1:i-1], p[i])) AS keep FROM t)
    SELECT conv_id, turn, md5(array_to_string(list_transform(keep, lambda i: p[i]), chr(10))) AS digest FROM u""",
)
def _(v: Views) -> DataFrame:
    joined = X.assemble_content(
        F.col("text"), F.col("role"), F.split_part("text", F.lit("."), F.lit(1)), F.concat(F.lit(" "), "role")
    )
    return v.table("conversations").select("conv_id", "turn", F.md5(joined).alias("digest"))


@query(
    "length_gate",
    """
    SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty_input' WHEN length(text) > 6000 THEN
      CASE WHEN doc_id % 2 = 0 THEN 'low_ocr' ELSE 'unsupported_media' END END AS status FROM documents""",
)
def _(v: Views) -> DataFrame:
    typed = v.table("documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "image").otherwise("text").alias("input_type")
    )
    return triage.length_gate(typed).select("doc_id", "status")


@query(
    "script_word_counts",
    """
    SELECT msg_id, len(regexp_extract_all(text, '[Ѐ-ӿ]+')) AS cyrillic,
           len(regexp_extract_all(text, '[A-Za-zʼ'']+')) AS latin FROM messages""",
    ("messages",),
)
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", X.script_word_counts(F.col("text")).alias("n")).select("msg_id", "n.*")


@query(
    "resolve_language",
    f"""
    WITH t AS (SELECT msg_id, ' ' || lower(text) || ' ' AS p, language FROM messages),
         n AS (SELECT *, len(regexp_extract_all(p, '[Ѐ-ӿ]+')) AS c, len(regexp_extract_all(p, '[a-zʼ'']+')) AS l FROM t)
    SELECT msg_id, CASE WHEN l > c THEN CASE WHEN {" OR ".join(f"contains(p, {quoted(m)})" for m in V.UZ_LATIN_MARKERS)}
             THEN 'uz_latn' WHEN language = 'de' THEN 'uz_latn' ELSE 'ru' END ELSE 'ru' END AS reply_language FROM n""",
    ("messages",),
)
def _(v: Views) -> DataFrame:
    # The detector column says "uz" for German texts with probability 0.9, and for Spanish with 0.5.
    language = X.resolve_language(
        F.col("text"), F.lit("ru"),
        F.when(F.col("language").isin("de", "es"), "uz"),
        F.when(F.col("language") == "de", 0.9).otherwise(0.5),
    )
    return v.messages.select("msg_id", language.alias("reply_language"))


@query(
    "flag_meta",
    """
    WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Bot,  ' || n_name || ' ?!' WHEN 1 THEN n_name || ' and more'
                 WHEN 2 THEN '  ' || lower(n_name) || '... ' ELSE c_name END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(text)), '^bot[,:\\s]+', ''), '[?!.,;:…\\s]+$', '')
             IN (SELECT lower(n_name) FROM nation) AS is_meta FROM t""",
)
def _(v: Views) -> DataFrame:
    name, key = F.col("n_name"), F.col("c_custkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("Bot,  "), name, F.lit(" ?!")))
        .when(key % 4 == 1, F.concat(name, F.lit(" and more")))
        .when(key % 4 == 2, F.concat(F.lit("  "), F.lower(name), F.lit("... ")))
        .otherwise(F.col("c_name"))
    )
    nation = v.table("nation")
    said = v.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.alias("text"))
    phrases = nation.select(F.lower("n_name").alias("phrase"))
    return triage.flag_meta(said, phrases, ("bot",)).select("c_custkey", "is_meta")


@query(
    "localize_status",
    """
    WITH copy AS (SELECT s.status, l.language, s.status || ' / ' || l.language AS message
                  FROM (SELECT DISTINCT status FROM check_event WHERE status <> 'ok' UNION SELECT 'unsupported_media') s,
                       (SELECT DISTINCT language FROM check_event) l)
    SELECT e.id, coalesce(c.message, 'unsupported_media / ' || e.language) AS message
    FROM check_event e LEFT JOIN copy c ON e.status = c.status AND e.language = c.language""",
    ("check_event",),
)
def _(v: Views) -> DataFrame:
    known = v.check_event.filter(F.col("status") != "ok").select("status", "language")
    known = known.unionByName(v.check_event.select(F.lit("unsupported_media").alias("status"), "language")).distinct()
    copy = known.withColumn("message", F.concat_ws(" / ", "status", "language"))
    return triage.localize_status(v.check_event.select("id", "status", "language"), copy).select("id", "message")


_HEADINGS = [
    (code, f"{code} flags", f"{code} pattern:", f"{code} verify", f"{code} ask", f"{code} quiet", f"{code} limits")
    for code in ("ru", "uz_latn")
]


@query(
    "render_answer",
    """
    WITH d AS (SELECT *, NOT has_hit AND len(red_flags) = 0 AS no_signal FROM drafts)
    SELECT check_id, md5(array_to_string(list_filter([
      CASE WHEN no_signal THEN language || ' quiet' WHEN len(red_flags) > 0 THEN
        language || ' flags' || chr(10) || array_to_string(list_transform(red_flags[1:3], lambda b: '- ' || b), chr(10)) END,
      CASE WHEN pattern <> '' THEN language || ' pattern: ' || pattern END,
      CASE WHEN len(verify) > 0 THEN language || ' verify' || chr(10) || array_to_string(list_transform(verify[1:3], lambda b: '- ' || b), chr(10)) END,
      language || ' limits',
      CASE WHEN len(ask) > 0 THEN language || ' ask' || chr(10) || array_to_string(list_transform(ask[1:3], lambda b: '- ' || b), chr(10)) END
    ], lambda b: b IS NOT NULL), chr(10) || chr(10))) AS digest FROM d""",
    ("drafts",),
)
def _(v: Views) -> DataFrame:
    headings = v.spark.createDataFrame(
        _HEADINGS,
        "language string, red_flags_title string, pattern_title string, verify_title string, ask_title string, "
        "no_signal_text string, limitation_text string",
    )
    drafts = v.drafts.withColumn("no_signal", (F.size("hits") == 0) & (F.size("red_flags") == 0))
    return triage.render_answer(drafts, headings).select("check_id", F.md5("answer").alias("digest"))


_TEMPLATE = "lang={language}\ntext={minimized_text}\nhits:\n{rule_hits}\nsignals={signals}\ncards:\n{knowledge}\n"


@query(
    "assemble_prompts",
    f"""
    WITH h AS (SELECT msg_id, array_to_string(list(line ORDER BY rule_order), chr(10)) AS lines FROM (
                 SELECT msg_id, rule_order, '- ' || rule_id || ' | family=' || family || ' | severity=' || severity ||
                        ': Passage of item ' || rule_order AS line FROM rule_hits) GROUP BY msg_id),
         s AS (SELECT msg_id, array_to_string(list('{{"kind": "bench_even", "note": "' || family || '"}}' ORDER BY first), ', ') AS j
               FROM (SELECT msg_id, family, min(rule_order) AS first FROM rule_hits WHERE emits_signal IS NOT NULL GROUP BY ALL) GROUP BY msg_id)
    SELECT m.msg_id, md5('lang=' || coalesce(language, 'none') || chr(10) || 'text="' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')
      || '"' || chr(10) || 'hits:' || chr(10) || coalesce(lines, '- (none detected)') || chr(10) || 'signals=[' || coalesce(j, '') || ']' || chr(10)
      || 'cards:' || chr(10) || '- (none selected)' || chr(10)) AS digest
    FROM messages m LEFT JOIN h USING (msg_id) LEFT JOIN s USING (msg_id)""",
    ("messages", "rule_hits"),
)
def _(v: Views) -> DataFrame:
    described = F.transform(
        "hits",
        lambda h: F.struct(
            h.rule_id.alias("rule_id"), h.family.alias("family"), h.severity.alias("severity"),
            h.message_key.alias("message_key"),
            F.concat(F.lit("Passage of item "), F.split_part(h.rule_id, F.lit("_"), F.lit(2))).alias("desc"),
        ),
    )
    emitted = F.array_distinct(
        F.transform(
            F.filter("hits", lambda h: h.emits_signal.isNotNull()), lambda h: S.signal(h.emits_signal, h.family)
        )
    )
    cards = F.array().cast(
        "array<struct<id:string,version:string,mechanism:string,red_flags:array<string>,"
        "verify_steps:array<string>,questions:array<string>>>"
    )
    matched = RU.with_rule_hits(RU.with_normalized(v.messages), v.patterns)
    ready = matched.select(
        "msg_id", F.coalesce("language", F.lit("none")).alias("language"), F.col("text").alias("minimized"),
        emitted.alias("signals"), described.alias("hits"), cards.alias("cards"),
    )
    return triage.assemble_prompts(ready, _TEMPLATE).select("msg_id", F.md5("prompt").alias("digest"))


@query(
    "select_ocr",
    """
    WITH c AS (SELECT conv_id, turn, role, trim(text) AS text, (turn * 37 + conv_id) % 100 / 100.0 AS confidence FROM conversations),
         r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) * confidence DESC, turn) AS rn FROM c)
    SELECT conv_id AS image_id, role AS script, md5(text) AS digest, CASE WHEN text = '' OR confidence < 0.5 THEN 'low_ocr' END AS status
    FROM r WHERE rn = 1""",
)
def _(v: Views) -> DataFrame:
    candidates = v.table("conversations").select(
        F.col("conv_id").alias("image_id"), F.col("turn").alias("script_order"), F.col("role").alias("script"),
        F.trim("text").alias("text"),
        ((F.col("turn") * 37 + F.col("conv_id")) % 100 / 100).alias("confidence"),
    )
    return triage.select_ocr(candidates).select("image_id", "script", F.md5("text").alias("digest"), "status")


@query(
    "media_status",
    """
    WITH m AS (SELECT doc_id, doc_id % 3 AS qr_count, CASE WHEN doc_id % 3 = 1 THEN trim(text) END AS qr,
                      CASE WHEN doc_id % 5 = 1 THEN NULL ELSE source END AS ocr, (doc_id % 10) / 10.0 AS conf,
                      CASE doc_id % 11 WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid_image' WHEN 3 THEN 'provider' END AS err FROM documents)
    SELECT doc_id, CASE WHEN qr_count > 1 THEN 'low_ocr' WHEN length(qr) > 6000 THEN 'low_ocr'
        WHEN err IS NOT NULL AND qr IS NULL THEN CASE err WHEN 'timeout' THEN 'timeout' WHEN 'invalid_image' THEN 'unsupported_media' ELSE 'ocr_error' END
        WHEN err IS NULL AND qr IS NULL AND (ocr IS NULL OR conf < 0.5) THEN 'low_ocr' END AS status,
      CASE WHEN qr_count > 1 THEN 'MultipleQRCodes' WHEN length(qr) > 6000 THEN 'QRPayloadTooLong' END AS error_class
    FROM m""",
)
def _(v: Views) -> DataFrame:
    n = F.col("doc_id")
    media = v.table("documents").select(
        "doc_id", (n % 3).alias("qr_count"), F.when(n % 3 == 1, F.col("text")).alias("qr_text"),
        F.when(n % 5 != 1, F.col("source")).alias("ocr_text"), (n % 10 / 10).alias("ocr_confidence"),
        F.when(n % 11 == 1, "timeout").when(n % 11 == 2, "invalid_image").when(n % 11 == 3, "provider").alias("ocr_error"),
        F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("raw_text"),
    )
    return triage.media_status(media).select("doc_id", "status", "error_class")


# --- C: rules ---------------------------------------------------------------------------------------

_HITS_SQL = "SELECT msg_id, rule_id, family, severity FROM rule_hits"


@query("rule_hits", _HITS_SQL, ("rule_hits",))
def _(v: Views) -> DataFrame:
    return RU.rule_hits(v.messages, v.patterns).select("msg_id", "rule_id", "family", "severity")


@query("rule_hits_large_pack", _HITS_SQL, ("rule_hits",))
def _(v: Views) -> DataFrame:
    hits = RU.rule_hits(v.messages, v.patterns, inline_limit=0)
    return hits.select("msg_id", "rule_id", "family", "severity")


@query(
    "regex_rule_hits",
    f"""
    WITH r AS (SELECT item_id, unnest(string_split({norm("text")}, '. ')) AS s FROM benchmark)
    SELECT DISTINCT msg_id, 'word.item_' || item_id AS rule_id FROM normal JOIN r ON contains(normalized, s)""",
    ("normal",),
)
def _(v: Views) -> DataFrame:
    return RU.rule_hits(v.messages, RU.flatten_rules(_sentence_rules(v))).select("msg_id", "rule_id")


def _sentence_rules(v: Views) -> DataFrame:
    """One expression per sentence of an item, its words with any space between them, and one that does not compile."""
    sentence = F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), r"\. ")
    escaped = F.transform(sentence, lambda s: F.regexp_replace(s, r"([.\\+*?\[^\]$(){}=!<>|:\-#,])", r"\\$1"))
    expression = F.transform(escaped, lambda s: F.concat(F.lit("regex:"), F.replace(s, F.lit(" "), F.lit(r"\s+"))))
    return v.table("benchmark").select(
        F.col("item_id").alias("rule_order"), F.concat(F.lit("word.item_"), "item_id").alias("rule_id"),
        F.lit("words").alias("family"), F.lit("Two words").alias("desc"), F.lit("two_words").alias("message_key"),
        F.lit(1).alias("severity"), F.lit(None).cast("string").alias("emits_signal"),
        F.create_map(F.lit("uz_latn"), F.array_append(expression, F.lit("regex:([unclosed"))).alias("match"),
    )


@query(
    "regex_rule_hits_large_pack",
    f"""
    WITH r AS (SELECT 'word.item_' || item_id AS rule_id, unnest(string_split({norm("text")}, '. ')) AS s FROM benchmark
               UNION ALL SELECT 'order.' || o_orderkey, lower(o_orderstatus || ' ' || o_orderkey) FROM orders)
    SELECT DISTINCT msg_id, rule_id FROM normal JOIN r ON contains(normalized, s)""",
    ("normal",),
)
def _(v: Views) -> DataFrame:
    # One expression for each order besides the sentences; all of them meet the messages in one pass.
    key = F.col("o_orderkey")
    text = F.concat(F.lit("regex:"), F.lower("o_orderstatus"), F.lit(r"\s+"), key)
    orders = v.table("orders").select(
        key.alias("rule_order"), F.concat(F.lit("order."), key).alias("rule_id"), F.lit("orders").alias("family"), F.lit("Order").alias("desc"),
        F.lit("order").alias("message_key"), F.lit(1).alias("severity"), F.lit(None).cast("string").alias("emits_signal"),
        F.create_map(F.lit("uz_latn"), F.array(text)).alias("match"),
    )
    rules = _sentence_rules(v).withColumn("rule_order", F.col("rule_order").cast("bigint")).unionByName(orders)
    return RU.rule_hits(v.messages, RU.flatten_rules(rules), inline_limit=0).select("msg_id", "rule_id")


@query(
    "matching_patterns",
    "SELECT n.msg_id, p.rule_id, p.pattern FROM normal n JOIN patterns p ON contains(n.normalized, p.needle)",
    ("normal", "patterns"),
)
def _(v: Views) -> DataFrame:
    return RU.matching_patterns(v.messages, v.patterns)


@query(
    "rule_signals",
    "SELECT DISTINCT msg_id, emits_signal AS kind, family AS note FROM rule_hits WHERE emits_signal IS NOT NULL",
    ("rule_hits",),
)
def _(v: Views) -> DataFrame:
    return RU.rule_signals(RU.rule_hits(v.messages, v.patterns))


_MERGE_VIEWS = """
    base AS (SELECT p_partkey AS rule_order, 'part.p' || p_partkey AS rule_id, replace(lower(p_name), ' ', '_') AS family, p_size % 3 + 1 AS severity FROM part),
    over AS (SELECT CASE WHEN s_suppkey % 3 = 2 THEN 'supp.s' || s_suppkey ELSE 'part.p' || s_suppkey END AS rule_id, 'supplier' AS family,
                    2 AS severity, s_suppkey % 3 = 1 AS disabled, s_suppkey FROM supplier)"""


def _rule_overrides(v: Views) -> tuple[DataFrame, DataFrame]:
    def pack(df: DataFrame, rule_id, family, severity, *more) -> DataFrame:
        return df.select(
            *more, rule_id.alias("rule_id"), family.alias("family"), F.lit("desc").alias("desc"),
            F.lit("key").alias("message_key"), severity.cast("int").alias("severity"),
            F.lit(None).cast("string").alias("emits_signal"),
            F.create_map(F.lit("ru"), F.array(F.lit("word"))).alias("match"),
        )

    base = pack(
        v.table("part"), F.concat(F.lit("part.p"), "p_partkey"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")),
        F.col("p_size") % 3 + 1, F.col("p_partkey").alias("rule_order"),
    )
    key = F.col("s_suppkey")
    over = pack(
        v.table("supplier"), F.concat(F.when(key % 3 == 2, "supp.s").otherwise("part.p"), key), F.lit("supplier"),
        F.lit(2), (key % 3 == 1).alias("disabled"), F.timestamp_seconds(key + 1).alias("updated_ts"),
    )
    return base, over


@query(
    "merge_rules",
    f"""WITH {_MERGE_VIEWS}
    SELECT rule_id, family, severity, row_number() OVER (ORDER BY added, rule_order, rule_id) - 1 AS position FROM (
      SELECT coalesce(b.rule_id, o.rule_id) AS rule_id, coalesce(o.family, b.family) AS family, CAST(coalesce(o.severity, b.severity) AS BIGINT) AS severity,
             b.rule_id IS NULL AS added, coalesce(b.rule_order, -o.s_suppkey) AS rule_order
      FROM base b FULL JOIN (SELECT * FROM over WHERE NOT disabled) o ON b.rule_id = o.rule_id)
    WHERE rule_id NOT IN (SELECT rule_id FROM over WHERE disabled)""",
)
def _(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    merged = RU.merge_rules(*_rule_overrides(v))
    position = F.row_number().over(W.orderBy("rule_order", "rule_id")) - 1
    return merged.select("rule_id", "family", "severity", position.alias("position"))


@query(
    "validate_rule_overrides",
    """
    WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 1 THEN 'Bad Id!' ELSE ' Part.P' || p_partkey || ' ' END AS rule_id, lower(trim(p_name)) AS family,
                 p_size % 5 AS severity, CASE WHEN p_partkey % 7 = 3 THEN 'xx' WHEN p_partkey % 7 = 4 THEN repeat('y', 121) ELSE p_name END AS pattern FROM part)
    SELECT p_partkey, CASE WHEN NOT regexp_full_match(lower(trim(rule_id)), '[a-z][a-z0-9]*(?:\\.[a-z0-9_]+)+') THEN 'invalid_rule_id'
        WHEN severity NOT BETWEEN 1 AND 3 THEN 'invalid_severity' WHEN length(pattern) > 120 THEN 'pattern_too_long'
        WHEN p_partkey % 13 = 5 THEN 'invalid_regex' WHEN length(pattern) < 3 THEN 'pattern_too_short' END AS reason FROM o""",
)
def _(v: Views) -> DataFrame:
    n = F.col("p_partkey")
    pattern = F.when(n % 7 == 3, "xx").when(n % 7 == 4, F.repeat(F.lit("y"), F.lit(121))).otherwise(F.col("p_name"))
    broken = F.when(n % 13 == 5, F.array(pattern, F.lit("regex: (open"))).otherwise(F.array(pattern))
    overrides = v.table("part").select(
        "p_partkey", F.when(n % 9 == 1, "Bad Id!").otherwise(F.concat(F.lit(" Part.P"), n, F.lit(" "))).alias("rule_id"),
        F.lit("parts").alias("family"), F.lit(" Some text ").alias("desc"), F.lit("a_key").alias("message_key"),
        (F.col("p_size") % 5).cast("int").alias("severity"), F.lit(None).cast("string").alias("emits_signal"),
        F.create_map(F.lit("ru"), broken).alias("match"), F.lit(False).alias("disabled"),
    )
    parts = RU.validate_rule_overrides(overrides)
    none = F.lit(None).cast("string").alias("reason")
    return parts["valid"].select("p_partkey", none).unionByName(parts["quarantine"].select("p_partkey", "reason"))


@query(
    "summarize_hits",
    """
    SELECT msg_id, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rule_ids, array_to_string(list_sort(list(DISTINCT family)), ',') AS families,
           CAST(max(severity) AS BIGINT) AS max_severity, bool_or(severity >= 2) AS needs_red_flag FROM rule_hits GROUP BY msg_id""",
    ("rule_hits",),
)
def _(v: Views) -> DataFrame:
    return RU.summarize_hits(RU.rule_hits(v.messages, v.patterns))


_TOP_SQL = """
    WITH x AS (SELECT id, unnest(rule_ids) AS rule_id, unnest(range(len(rule_ids))) AS pos FROM check_event),
         b AS (SELECT id, family, max(severity) AS sev, arg_min(pos, [-severity, pos]) AS pos FROM x JOIN model_rules USING (rule_id) GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sev DESC, pos, family) AS rn FROM b),
         top AS (SELECT id AS check_id, list(family ORDER BY rn) AS families FROM k WHERE rn <= 3 GROUP BY id)"""


@query(
    "top_families", _TOP_SQL + " SELECT check_id, array_to_string(families, ',') AS families FROM top",
    ("check_event", "model_rules"),
)
def _(v: Views) -> DataFrame:
    return RU.top_families(v.check_event.withColumnRenamed("id", "check_id"), v.model_rules)


@query(
    "share_summary",
    _TOP_SQL
    + """
    SELECT e.id AS check_id, CASE WHEN families IS NULL THEN language || ' generic' || chr(10) || language || ' cta'
      ELSE language || ' lead' || chr(10) || language || ' found: ' ||
        array_to_string(list_transform(families, lambda f: CASE WHEN f = 'family_0' THEN 'zero ' || language ELSE replace(f, '_', ' ') END), ', ')
        || '.' || chr(10) || language || ' caution' || chr(10) || language || ' cta' END AS summary
    FROM check_event e LEFT JOIN top ON e.id = top.check_id""",
    ("check_event", "model_rules"),
)
def _(v: Views) -> DataFrame:
    languages = v.check_event.select("language").distinct()
    labels = languages.select("language", F.lit("family_0").alias("family"), F.concat(F.lit("zero "), "language").alias("label"))
    copy = languages.select(
        "language",
        *[F.concat("language", F.lit(f" {n}")).alias(n) for n in ("lead", "generic", "caution", "cta")],
        F.concat("language", F.lit(" found: {families}.")).alias("families"),
    )
    checks = v.check_event.select(F.col("id").alias("check_id"), "language", "rule_ids")
    top = checks.drop("rule_ids").join(RU.top_families(checks, v.model_rules), "check_id", "left")
    return RU.share_summary(top, labels, copy)


@query(
    "golden_recall",
    """
    WITH f AS (SELECT msg_id, list(DISTINCT family) AS fired FROM rule_hits GROUP BY msg_id),
         x AS (SELECT msg_id, CASE WHEN length(text) % 3 = 0 THEN ['family_' || (length(text) % 5)] ELSE CAST([] AS VARCHAR[]) END AS expected FROM messages)
    SELECT x.msg_id, array_to_string(list_sort(list_filter(expected, lambda e: NOT list_contains(coalesce(fired, []), e))), ',') AS missing,
           len(list_filter(expected, lambda e: NOT list_contains(coalesce(fired, []), e))) = 0 AS passed
    FROM x LEFT JOIN f USING (msg_id)""",
    ("messages", "rule_hits"),
)
def _(v: Views) -> DataFrame:
    n = F.length("text")
    expected = v.messages.select(
        "msg_id", F.when(n % 3 == 0, F.array(F.concat(F.lit("family_"), n % 5))).otherwise(strings()).alias("expected")
    )
    return RU.golden_recall(expected, RU.rule_hits(v.messages, v.patterns))


# --- D: links ---------------------------------------------------------------------------------------

_DOMAIN_SQL = r"""regexp_replace(lower(CASE msg_id % 8 WHEN 0 THEN host WHEN 1 THEN host WHEN 2 THEN host WHEN 3 THEN '192.0.2.' || (msg_id % 250)
    WHEN 4 THEN 'bit.ly' WHEN 5 THEN 'click.uz.' || host WHEN 6 THEN 'paymee-' || msg_id || '.example' ELSE 'th' || 'е' || 'st.' || host END), '^www\.', '')"""
_LABEL_SQL = f"""CASE msg_id % 8 WHEN 2 THEN 'credentials-in-url' WHEN 3 THEN 'ip-address' WHEN 4 THEN 'shortened' WHEN 5 THEN 'lookalike-domain'
    WHEN 6 THEN 'lookalike-domain' WHEN 7 THEN 'mixed-script-domain' END"""

# An address like name@host is taken for an e-mail before links are looked at.
_PLAIN_LABEL_SQL = f"nullif({_LABEL_SQL}, 'credentials-in-url')"


@query(
    "describe_link",
    f"SELECT msg_id, {_DOMAIN_SQL} AS domain, msg_id % 8 = 2 AS has_userinfo, msg_id % 8 = 3 AS is_ip, msg_id % 8 = 7 AS mixed_script FROM links",
    ("links",),
)
def _(v: Views) -> DataFrame:
    return linkage.described_links(v.links).drop("raw_url")


@query("normalize_domain", r"SELECT page_id, regexp_replace(lower(split_part(url, '/', 3)), '^www\.', '') AS domain FROM pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", L.normalize_domain(F.col("url")).alias("domain"))


@query(
    "extract_urls",
    """
    SELECT msg_id, CAST(0 AS BIGINT) AS position, raw_url || CASE WHEN msg_id % 8 IN (4, 5, 6) AND NOT contains(raw_url, '/') THEN '' WHEN msg_id % 8 = 6 THEN '' ELSE ',' END AS raw_url FROM link_messages
    UNION ALL SELECT msg_id, 1, url FROM link_messages""",
    ("link_messages",),
)
def _(v: Views) -> DataFrame:
    return linkage.message_links(v.link_messages)


@query(
    "message_domains",
    rf"""
    WITH d AS (SELECT msg_id, [{_DOMAIN_SQL}, regexp_replace(lower(host), '^www\.', '')] AS ds FROM links)
    SELECT msg_id, CAST(0 AS BIGINT) AS position, ds[1] AS domain FROM d UNION ALL SELECT msg_id, 1, ds[2] FROM d WHERE ds[1] <> ds[2]""",
    ("links",),
)
def _(v: Views) -> DataFrame:
    return linkage.message_domains(v.link_messages)


@query(
    "is_ip",
    rf"SELECT msg_id, regexp_full_match({_DOMAIN_SQL}, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS is_ip FROM links",
    ("links",),
)
def _(v: Views) -> DataFrame:
    return v.links.select("msg_id", L.is_ip(L.normalize_domain(F.col("raw_url"))).alias("is_ip"))


@query(
    "script_count",
    f"""
    SELECT msg_id, CAST(regexp_matches(d, '[a-z]') AS BIGINT) + CAST(regexp_matches(d, '[а-я]') AS BIGINT) AS scripts
    FROM (SELECT msg_id, {_DOMAIN_SQL} AS d FROM links)""",
    ("links",),
)
def _(v: Views) -> DataFrame:
    return v.links.select("msg_id", L.script_count(L.normalize_domain(F.col("raw_url"))).alias("scripts"))


@query("fold_confusables", f"SELECT msg_id, translate({_DOMAIN_SQL}, 'аеорсух', 'aeopcyx') AS folded FROM links", ("links",))
def _(v: Views) -> DataFrame:
    return v.links.select("msg_id", L.fold_confusables(L.normalize_domain(F.col("raw_url"))).alias("folded"))


def _catalog(v: Views) -> dict[str, DataFrame]:
    """The floor catalog, with every page host that starts with ``www.`` as a brand of its own."""
    base = refdata.base_catalog(v.spark)
    own = v.table("pages").filter(F.col("url").contains("://www.")).select(
        L.normalize_domain(F.col("url")).alias("domain")
    ).distinct().select(F.split_part("domain", F.lit("."), F.lit(1)).alias("brand"), "domain")
    return {**base, "brands": base["brands"].unionByName(own)}


_BRANDS_SQL = (
    "brands AS (SELECT * FROM (VALUES "
    + ", ".join(f"({quoted(b)}, {quoted(d)})" for b, ds in V.BRAND_DOMAINS.items() for d in ds)
    + r""") t(brand, domain) UNION ALL
    SELECT DISTINCT split_part(d, '.', 1), d FROM (SELECT regexp_replace(split_part(url, '/', 3), '^www\.', '') AS d FROM pages WHERE contains(url, '://www.'))),
    doms AS (SELECT DISTINCT """
    + _DOMAIN_SQL
    + """ AS domain, msg_id % 8 = 7 AS mixed FROM links)"""
)
_OWNED = "(d.domain = b.domain OR ends_with(d.domain, '.' || b.domain))"


@query(
    "is_official",
    f"WITH {_BRANDS_SQL} SELECT DISTINCT d.domain, b.brand FROM doms d JOIN brands b ON {_OWNED}",
    ("links",),
)
def _(v: Views) -> DataFrame:
    domains = linkage.described_links(v.links).select("domain").distinct()
    return linkage.official_domains(domains, _catalog(v)["brands"])


@query("is_shortener", f"SELECT DISTINCT domain FROM (SELECT {_DOMAIN_SQL} AS domain FROM links) WHERE domain = 'bit.ly'", ("links",))
def _(v: Views) -> DataFrame:
    domains = linkage.described_links(v.links).select("domain").distinct()
    return linkage.shortened_domains(domains, refdata.base_catalog(v.spark)["shorteners"])


_LIKE_SQL = f"""
    cand AS (SELECT DISTINCT f.domain, f.mixed, b.brand FROM (SELECT *, translate(domain, 'аеорсух', 'aeopcyx') AS folded FROM doms) f
             JOIN (SELECT DISTINCT brand FROM brands) b ON contains(folded, b.brand) OR (length(b.brand) >= 4 AND len(list_filter(
               regexp_split_to_array(folded, '[^a-z0-9]+'), lambda l: abs(length(l) - length(b.brand)) <= 1 AND levenshtein(l, b.brand) <= 1)) > 0)),
    likes AS (SELECT d.domain, d.brand FROM cand d WHERE d.mixed OR NOT EXISTS (SELECT 1 FROM brands b WHERE b.brand = d.brand AND {_OWNED}))"""


@query("brand_lookalike", f"WITH {_BRANDS_SQL}, {_LIKE_SQL} SELECT DISTINCT domain, brand FROM likes", ("links",))
def _(v: Views) -> DataFrame:
    hosts = linkage.described_links(v.links).select("domain", "mixed_script").distinct()
    return linkage.brand_lookalikes(hosts, _catalog(v)["brands"])


@query(
    "nested_suffix",
    f"""
    SELECT msg_id, len(list_filter(string_split(d, '.')[1:-3], lambda l: l IN ('uz', 'com', 'net', 'org', 'ru'))) > 0 AS nested
    FROM (SELECT msg_id, {_DOMAIN_SQL} AS d FROM links)""",
    ("links",),
)
def _(v: Views) -> DataFrame:
    nested = L.has_nested_suffix(L.normalize_domain(F.col("raw_url")), V.NESTED_SUFFIXES)
    return v.links.select("msg_id", nested.alias("nested"))


_CLASSIFY_SQL = f"""
    WITH {_BRANDS_SQL}, {_LIKE_SQL}
    SELECT msg_id, domain, CASE WHEN msg_id % 8 = 2 THEN 'credentials-in-url' WHEN msg_id % 8 = 3 THEN 'ip-address' WHEN msg_id % 8 = 4 THEN 'shortened'
      WHEN domain IN (SELECT domain FROM likes) THEN 'lookalike-domain'
      WHEN len(list_filter(string_split(domain, '.')[1:-3], lambda l: l IN ('uz', 'com', 'net', 'org', 'ru'))) > 0 THEN 'domain-in-subdomain'
      WHEN msg_id % 8 = 7 THEN 'mixed-script-domain' END AS label
    FROM (SELECT msg_id, {_DOMAIN_SQL} AS domain FROM links)"""


@query("classify_links", _CLASSIFY_SQL, ("links",))
def _(v: Views) -> DataFrame:
    return linkage.classify_links(v.links, **_named(v)).select("msg_id", "domain", "label")


@query("classify_links_large_catalog", _CLASSIFY_SQL, ("links",))
def _(v: Views) -> DataFrame:
    return linkage.classify_links(v.links, **_named(v), limit=0).select("msg_id", "domain", "label")


def _named(v: Views) -> dict[str, DataFrame]:
    catalog = _catalog(v)
    return {
        "brands": catalog["brands"], "shorteners": catalog["shorteners"], "suffixes": catalog["nested_suffixes"],
    }


def _large_catalog(v: Views) -> dict[str, DataFrame]:
    """The catalog with a brand for every order and one for the first label of every page host, elsewhere at home."""
    named, order = _named(v), F.concat(F.lit("shop"), "o_orderkey")
    shops = v.table("orders").select(order.alias("brand"), F.concat(order, F.lit(".example")).alias("domain"))
    label = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    hosts = v.table("pages").select(label.alias("brand"), F.concat(label, F.lit(".uz")).alias("domain")).filter(F.length("brand") > 4).distinct()
    return {**named, "brands": named["brands"].unionByName(shops).unionByName(hosts)}


_URL_DOMAIN_SQL = r"regexp_replace(split_part(url, '/', 3), '^www\.', '')"
#: Labels of the first (raw) and the second (plain) link of each link message under the large catalog.
_LARGE_LABELS_SQL = f"""{_BRANDS_SQL.replace("FROM pages WHERE contains(url, '://www.'))),", f"""FROM pages WHERE contains(url, '://www.'))
      UNION ALL SELECT 'shop' || o_orderkey, 'shop' || o_orderkey || '.example' FROM orders
      UNION ALL SELECT DISTINCT b, b || '.uz' FROM (SELECT split_part(split_part(url, '/', 3), '.', 1) AS b FROM pages) WHERE length(b) > 4),""")},
    page_doms AS (SELECT DISTINCT {_URL_DOMAIN_SQL} AS domain, FALSE AS mixed FROM pages),
    {_LIKE_SQL.replace("FROM doms)", "FROM (SELECT * FROM doms UNION SELECT * FROM page_doms))")},
    two AS (SELECT msg_id, {_DOMAIN_SQL} AS d1, msg_id % 8 AS m, {_URL_DOMAIN_SQL} AS d2 FROM links),
    labels AS (SELECT msg_id, m,
      CASE WHEN m = 2 THEN NULL WHEN m = 3 THEN 'ip-address' WHEN m = 4 THEN 'shortened' WHEN d1 IN (SELECT domain FROM likes) THEN 'lookalike-domain'
        WHEN len(list_filter(string_split(d1, '.')[1:-3], lambda l: l IN ('uz', 'com', 'net', 'org', 'ru'))) > 0 THEN 'domain-in-subdomain'
        WHEN m = 7 THEN 'mixed-script-domain' END AS raw_label,
      CASE WHEN d2 IN (SELECT domain FROM likes) THEN 'lookalike-domain'
        WHEN len(list_filter(string_split(d2, '.')[1:-3], lambda l: l IN ('uz', 'com', 'net', 'org', 'ru'))) > 0 THEN 'domain-in-subdomain' END AS url_label FROM two)"""


@query(
    "merge_catalog",
    r"""
    WITH floor AS (SELECT 'brand' || s_suppkey AS brand, 'supplier' || s_suppkey || '.example' AS domain FROM supplier),
         extra AS (SELECT ' Brand' || page_id || ' ' AS brand, CASE WHEN page_id % 5 = 4 THEN '...' ELSE split_part(url, '/', 3) END AS domain FROM pages),
         clean AS (SELECT DISTINCT lower(trim(brand)) AS brand, regexp_replace(domain, '^www\.', '') AS domain FROM extra WHERE domain <> '...')
    SELECT * FROM floor WHERE brand NOT IN (SELECT brand FROM clean) UNION ALL SELECT * FROM clean""",
)
def _(v: Views) -> DataFrame:
    floor = v.table("supplier").select(
        F.concat(F.lit("brand"), "s_suppkey").alias("brand"),
        F.concat(F.lit("supplier"), "s_suppkey", F.lit(".example")).alias("domain"),
    )
    extra = v.table("pages").select(
        F.concat(F.lit(" Brand"), "page_id", F.lit(" ")).alias("brand"),
        F.when(F.col("page_id") % 5 == 4, "...").otherwise(F.split_part("url", F.lit("/"), F.lit(3))).alias("domain"),
    )
    return linkage.merge_brands(floor, extra)


@query(
    "merge_catalog_lists",
    r"""
    WITH s AS (SELECT lower(n_name) || '.example' AS entry FROM nation UNION SELECT regexp_replace(split_part(url, '/', 3), '^www\.', '') FROM pages WHERE split_part(url, '/', 3) <> ''),
         x AS (SELECT lower(r_name) AS entry FROM region UNION SELECT DISTINCT role FROM conversations)
    SELECT 'shortener' AS list, entry FROM s UNION ALL SELECT 'suffix', entry FROM x""",
)
def _(v: Views) -> DataFrame:
    none = v.table("supplier").select(F.lit("b").alias("brand"), F.lit("b.example").alias("domain"))
    host = F.regexp_replace(F.split_part("url", F.lit("/"), F.lit(3)), r"^www\.", "")
    merged = linkage.merge_catalog(
        {
            "brands": none, "shorteners": v.table("nation").select(F.concat(F.lower("n_name"), F.lit(".example")).alias("domain")),
            "suffixes": v.table("region").select(F.lower("r_name").alias("label")),
        },
        {
            "brands": none, "shorteners": v.table("pages").select(F.concat(F.lit(" "), F.upper(host), F.lit(" ")).alias("domain")),
            "suffixes": v.table("conversations").select(F.upper("role").alias("label")),
        },
    )
    short = merged["shorteners"].select(F.lit("shortener").alias("list"), F.col("domain").alias("entry"))
    return short.unionByName(merged["suffixes"].select(F.lit("suffix").alias("list"), F.col("label").alias("entry")))


@query("hash_domain", r"SELECT page_id, sha256(regexp_replace(split_part(url, '/', 3), '^www\.', '')) AS domain_hash FROM pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", L.hash_domain(L.normalize_domain(F.col("url"))).alias("domain_hash"))


@query(
    "parse_threat_feed",
    r"""
    SELECT DISTINCT sha256(regexp_replace(d, '^www\.', '')) AS domain_hash, source FROM (
      SELECT split_part(url, '/', 3) AS d, ['urlhaus', 'openphish', 'local'][page_id % 3 + 1] AS source FROM pages
      UNION ALL SELECT 'p' || (page_id % 40) || '.feed.example', ['urlhaus', 'openphish', 'local'][page_id % 3 + 1] FROM pages)""",
)
def _(v: Views) -> DataFrame:
    line = F.concat(
        F.lit("# "), "page_id", F.lit(",\""), F.replace("url", F.lit("http"), F.lit("hxxp")),
        F.lit("\",seen p"), F.col("page_id") % 40, F.lit(".feed.example;"),
    )
    lines = v.table("pages").select(
        line.alias("value"), pick(F.col("page_id"), ("urlhaus", "openphish", "local")).alias("source")
    )
    return linkage.parse_threat_feed(lines)


BLOCK_ROWS_SQL = r"""
    block AS (SELECT sha256(d) AS domain_hash, source, min(seen) AS first_seen, max(seen) AS last_seen FROM (
      SELECT regexp_replace(split_part(url, '/', 3), '^www\.', '') AS d, ['urlhaus', 'openphish', 'local'][page_id % 3 + 1] AS source,
             TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 28 AS INTEGER)) AS seen FROM pages WHERE starts_with(url, 'http://')) GROUP BY ALL)"""
_FEED_SQL = r"feed AS (SELECT DISTINCT sha256(regexp_replace(split_part(url, '/', 3), '^www\.', '')) AS domain_hash, 'urlhaus' AS source FROM pages)"
BLOCK_UPSERT_SQL = f"""
    WITH {BLOCK_ROWS_SQL}, {_FEED_SQL}
    SELECT coalesce(b.domain_hash, f.domain_hash) AS domain_hash, coalesce(b.source, f.source) AS source,
      {stamp("coalesce(b.first_seen, TIMESTAMP '2024-03-01')")} AS first_seen,
      {stamp("CASE WHEN f.domain_hash IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE b.last_seen END")} AS last_seen
    FROM block b FULL JOIN feed f ON b.domain_hash = f.domain_hash AND b.source = f.source"""


def feed_hashes(pages: DataFrame) -> DataFrame:
    return pages.select(
        L.hash_domain(L.normalize_domain(F.col("url"))).alias("domain_hash"), F.lit("urlhaus").alias("source")
    )


FEED_TIME = "2024-03-01"


@query("upsert_blocklist", BLOCK_UPSERT_SQL)
def _(v: Views) -> DataFrame:
    now = F.lit(FEED_TIME).cast("timestamp")
    return linkage.upsert_blocklist(v.blocklist, feed_hashes(v.table("pages")), now)


@query(
    "reputation_hits",
    rf"""
    WITH {BLOCK_ROWS_SQL}, d AS (SELECT msg_id, {_DOMAIN_SQL} AS domain FROM links UNION SELECT msg_id, regexp_replace(lower(host), '^www\.', '') FROM links)
    SELECT msg_id, 'shared.link.blocklisted' AS rule_id, 'suspicious_link_qr' AS family, CAST(3 AS BIGINT) AS severity,
      array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, CAST(CAST(min(first_seen) AS DATE) AS VARCHAR) AS listed_since
    FROM d JOIN block ON sha256(d.domain) = domain_hash GROUP BY msg_id""",
    ("links",),
)
def _(v: Views) -> DataFrame:
    return linkage.reputation_hits(v.link_messages, v.blocklist)


# --- E: signals and redaction -----------------------------------------------------------------------


def _flag(name: str, spark_flag, pattern: str) -> None:
    sql = f"SELECT msg_id, regexp_matches(text, {quoted(edge(pattern))}) AS found FROM messages"

    @query(name, sql, ("messages",))
    def _(v: Views) -> DataFrame:
        return v.messages.select("msg_id", spark_flag(F.col("text")).alias("found"))


_flag("sig_email", S.has_email, V.EMAIL)
_flag("sig_handle", S.has_handle, V.HANDLE)
_flag("sig_phone", S.has_phone, V.PHONE)
_flag("sig_code", S.has_code, V.CODE_REQUEST)
_flag("sig_card", S.has_card, V.CARD)


@query(
    "sig_transfer_near_card",
    f"SELECT msg_id, regexp_matches(normalized, {quoted(re2(V.TRANSFER_NEAR_CARD))}) AS found FROM normal",
    ("normal",),
)
def _(v: Views) -> DataFrame:
    return RU.with_normalized(v.messages).select(
        "msg_id", S.has_transfer_near_card(F.col("normalized")).alias("found")
    )


_LINK_SIGNALS_SQL = f"""
    SELECT DISTINCT msg_id, coalesce(CASE label WHEN 'shortened' THEN 'link_shortened' WHEN 'lookalike-domain' THEN 'link_lookalike'
      WHEN 'mixed-script-domain' THEN 'link_lookalike' WHEN 'credentials-in-url' THEN 'link_userinfo' WHEN 'ip-address' THEN 'link_ip' END, 'link') AS kind,
      coalesce(label, '') AS note
    FROM (SELECT msg_id, {_PLAIN_LABEL_SQL} AS label FROM link_messages UNION ALL SELECT msg_id, NULL FROM link_messages)"""


@query("sig_links", _LINK_SIGNALS_SQL, ("link_messages",))
def _(v: Views) -> DataFrame:
    found = F.explode(S.link_signals(F.col("text"))).alias("s")
    return v.link_messages.select("msg_id", found).select(
        "msg_id", "s.kind", F.coalesce("s.note", F.lit("")).alias("note")
    ).distinct()


@query(
    "sig_links_large_catalog",
    f"""
    WITH {_LARGE_LABELS_SQL}
    SELECT DISTINCT msg_id, coalesce(CASE label WHEN 'shortened' THEN 'link_shortened' WHEN 'lookalike-domain' THEN 'link_lookalike'
      WHEN 'mixed-script-domain' THEN 'link_lookalike' WHEN 'ip-address' THEN 'link_ip' END, 'link') AS kind, coalesce(label, '') AS note
    FROM (SELECT msg_id, raw_label AS label FROM labels WHERE m <> 2 UNION ALL SELECT msg_id, url_label FROM labels)""",
    ("links",),
)
def _(v: Views) -> DataFrame:
    rows = linkage.with_link_labels(v.link_messages, _large_catalog(v), limit=0)
    found = F.explode_outer(S.link_signals(F.col("text"), L.LinkLabels(F.col("link_labels")))).alias("s")
    return rows.select("msg_id", found).filter("s is not null").select(
        "msg_id", "s.kind", F.coalesce("s.note", F.lit("")).alias("note")
    ).distinct()


@query(
    "minimize_strict_large_catalog",
    f"""
    WITH {_LARGE_LABELS_SQL}
    SELECT msg_id, 'See ' || coalesce('[LINK: ' || raw_label || ']', '[LINK]') || ', then ' || coalesce('[LINK: ' || url_label || ']', '[LINK]')
      || ' or write to [EMAIL].' AS minimized FROM labels""",
    ("links",),
)
def _(v: Views) -> DataFrame:
    rows = linkage.with_link_labels(v.link_messages, _large_catalog(v), limit=0)
    return rows.select("msg_id", R.minimize_strict(F.col("text"), L.LinkLabels(F.col("link_labels"))).alias("minimized"))


STRUCTURAL_SQL = " UNION ALL ".join(
    f"SELECT msg_id, {quoted(kind)} AS kind, '' AS note FROM messages WHERE regexp_matches(text, {quoted(edge(p))})"
    for kind, p in (
        ("email", V.EMAIL), ("handle", V.HANDLE), ("phone", V.PHONE), ("code", V.CODE_REQUEST), ("card", V.CARD)
    )
) + f""" UNION ALL SELECT msg_id, 'card_personal', {quoted(V.TRANSFER_NOTE)} FROM normal WHERE regexp_matches(normalized, {quoted(re2(V.TRANSFER_NEAR_CARD))})
    UNION ALL SELECT DISTINCT msg_id, emits_signal, family FROM rule_hits WHERE emits_signal IS NOT NULL"""


@query("structural_signals", STRUCTURAL_SQL, ("messages", "normal", "rule_hits"))
def _(v: Views) -> DataFrame:
    return v.signalled.select("msg_id", F.explode_outer("signals").alias("s")).filter("s is not null").select(
        "msg_id", "s.kind", F.coalesce("s.note", F.lit("")).alias("note")
    )


def _redacted(name: str, spark_redact, pattern: str) -> None:
    """Compares how many spans each message has; texts differ between regex engines at boundaries."""
    sql = f"SELECT msg_id, len(regexp_extract_all(text, {quoted(edge(pattern))})) AS spans FROM messages"
    token = rf"\[{name.removeprefix('redact_').upper().replace('TME', 'HANDLE')}\]"

    @query(name, sql, ("messages",))
    def _(v: Views) -> DataFrame:
        spans = F.regexp_count(spark_redact(F.col("text")), F.lit(token))
        return v.messages.select("msg_id", spans.alias("spans"))


_redacted("redact_email", R.redact_email, V.EMAIL)
_redacted("redact_tme", R.redact_tme, V.TME)
_redacted("redact_handle", R.redact_handle, V.HANDLE)
_redacted("redact_phone", R.redact_phone, V.PHONE)
_redacted("redact_secret", R.redact_secret, V.SECRET_VALUE)
_redacted("redact_code", R.redact_code, V.CODE_VALUE)
_redacted("redact_passport", R.redact_passport, V.PASSPORT)
_redacted("redact_address", R.redact_address, V.ADDRESS)


@query(
    "redact_card",
    f"SELECT msg_id, regexp_matches(text, {quoted(edge(V.CARD))}) AS found FROM messages",
    ("messages",),
)
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", R.redact_card(F.col("text")).contains("[CARD]").alias("found"))


@query(
    "redact_name",
    r"""
    SELECT msg_id, regexp_matches(text, '(?:^|[^\p{L}\p{N}_\[])(?:[A-ZА-ЯЁЎҚҒҲ][a-zа-яёўқғҳ'']{2,}\s+){1,2}[A-ZА-ЯЁЎҚҒҲ][a-zа-яёўқғҳ'']{2,}(?:$|[^\p{L}\p{N}_\]])')
      AS found FROM messages""",
    ("messages",),
)
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", R.redact_name(F.col("text")).contains("[NAME]").alias("found"))


@query(
    "redact_link",
    """
    SELECT msg_id, 'See ' || CASE WHEN l IS NULL THEN '[LINK]' ELSE '[LINK: ' || l || ']' END || ', then [LINK] or write to help@[LINK].' AS redacted
    FROM (SELECT msg_id, """ + _LABEL_SQL + " AS l FROM link_messages)",
    ("link_messages",),
)
def _(v: Views) -> DataFrame:
    return v.link_messages.select("msg_id", R.redact_link(F.col("text")).alias("redacted"))


@query(
    "minimize_strict",
    """
    SELECT msg_id, 'See ' || CASE WHEN l IS NULL THEN '[LINK]' ELSE '[LINK: ' || l || ']' END || ', then [LINK] or write to [EMAIL].' AS minimized
    FROM (SELECT msg_id, """ + _PLAIN_LABEL_SQL + " AS l FROM link_messages)",
    ("link_messages",),
)
def _(v: Views) -> DataFrame:
    return v.link_messages.select("msg_id", R.minimize_strict(F.col("text")).alias("minimized"))


@query(
    "minimize_answer",
    """
    SELECT msg_id, 'See ' || raw_url || ', then ' || url || ' or write to [EMAIL].' AS minimized FROM link_messages""",
    ("link_messages",),
)
def _(v: Views) -> DataFrame:
    return v.link_messages.select("msg_id", R.minimize_answer(F.col("text")).alias("minimized"))


_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"
_PHONE_BODY = (
    r"(?:\+[0-9]{1,3}(?:[\s().-]*[0-9]){6,14}|(?:\+?998[\s().-]?)?(?:\(?[2-9][0-9]\)?[\s().-]?)[0-9]{3}[\s().-]?[0-9]{2}[\s().-]?[0-9]{2})"
)
# Boundaries are captured and put back; where two spans may share one, the step runs twice.
_REDACTION_STEPS = (
    (
        rf"(?:(^|{_NOT_WORD})[a-z0-9_][a-z0-9._%+-]*|({_WORD})[.%+-][a-z0-9._%+-]*)@[a-z0-9.-]+\.[a-z]{{2,}}",
        r"\1\2[EMAIL]",
        "gi",
    ),
    (rf"(^|{_NOT_WORD})@[a-z0-9_]{{4,32}}", r"\1[HANDLE]", "gi"),
    (rf"(^|[^0-9]){_PHONE_BODY}($|[^0-9])", r"\1[PHONE]\2", "g"),
    (rf"(^|{_NOT_WORD})((?:password|parol|пароль?)(?:\s+(?:is|bu|это))?[ \t:=\-–—]{{1,10}})(\S{{3,128}})", r"\1\2[SECRET]", "gi"),
    (rf"(^|{_NOT_WORD})((?:sms\s*)?(?:otp|kod|code|код|parol|пароль?|password)[^0-9]{{0,20}})([0-9]{{4,8}})($|[^0-9])", r"\1\2[CODE]\4", "gi"),
    (r"(^|[^a-zA-Z0-9])[a-z]{2}\s?[0-9]{7}($|[^a-zA-Z0-9])", r"\1[PASSPORT]\2", "gi"),
    (r"(^|[^0-9])(?:[0-9][ -]?){13,19}($|[^0-9])", r"\1[CARD]\2", "g"),
    (r"(^|[^0-9])(?:[0-9][ -]?){13,19}($|[^0-9])", r"\1[CARD]\2", "g"),
    (rf"(^|{_NOT_WORD})(?:ko['‘’]chasi|кучаси|кўчаси|улица|ул\.|street|st\.)\s+[^\n,.;]{{2,50}}[0-9]*", r"\1[ADDRESS]", "gi"),
)
_REDACTED_SQL = "text"
for _pattern, _token, _flags in _REDACTION_STEPS:
    _REDACTED_SQL = f"regexp_replace({_REDACTED_SQL}, {quoted(_pattern)}, {quoted(_token)}, {quoted(_flags)})"
_COUNTED = [t for t in V.REDACTION_TOKENS if t != "LINK"]  # no text of these tables holds a link


_NAME_STEP = (
    r"(^|[^\p{L}\p{N}_\[])(?:[A-ZА-ЯЁЎҚҒҲ][a-zа-яёўқғҳ']{2,}\s+){1,2}[A-ZА-ЯЁЎҚҒҲ][a-zа-яёўқғҳ']{2,}($|[^\p{L}\p{N}_\]])"
)
# Whitespace is doubled around this step, so that two neighbouring names do not share their boundary.
_DOUBLED_SQL = f"replace(replace({_REDACTED_SQL}, ' ', '  '), chr(10), chr(10) || chr(10))"
_NAMED_SQL = f"regexp_replace({_DOUBLED_SQL}, {quoted(_NAME_STEP)}, {quoted(chr(92) + '1[NAME]' + chr(92) + '2')}, 'g')"
_STRICT_SQL = f"replace(replace({_NAMED_SQL}, '  ', ' '), chr(10) || chr(10), chr(10))"


@query("minimize_strict_corpus", f"SELECT msg_id, {_STRICT_SQL} AS minimized FROM messages", ("messages",))
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", R.minimize_strict(F.col("text")).alias("minimized"))


@query("minimize_keep_names", f"SELECT msg_id, md5({_REDACTED_SQL}) AS digest FROM messages", ("messages",))
def _(v: Views) -> DataFrame:
    return v.messages.select("msg_id", F.md5(R.minimize_strict(F.col("text"), preserve_names=True)).alias("digest"))


@query(
    "redaction_report",
    "SELECT coalesce(language, 'none') AS language, count(*) AS messages, "
    + ", ".join(f"CAST(sum(len(regexp_extract_all(t, '\\[{t}\\]'))) AS BIGINT) AS {t.lower()}" for t in _COUNTED)
    + f" FROM (SELECT language, {_STRICT_SQL} AS t FROM messages) GROUP BY ALL",
    ("messages",),
)
def _(v: Views) -> DataFrame:
    counted = v.messages.select(
        F.coalesce("language", F.lit("none")).alias("language"),
        R.redaction_counts(R.minimize_strict(F.col("text"))).alias("n"),
    )
    sums = [F.sum(f"n.{t.lower()}").alias(t.lower()) for t in _COUNTED]
    return counted.groupBy("language").agg(F.count("*").alias("messages"), *sums)


@query(
    "screen_report",
    """
    SELECT coalesce(m.language, 'none') AS language, h.family, count(*) AS hits, CAST(max(severity) AS BIGINT) AS max_severity
    FROM rule_hits h JOIN messages m USING (msg_id) GROUP BY ALL""",
    ("messages", "rule_hits"),
)
def _(v: Views) -> DataFrame:
    screened = screen(v.messages, v.patterns)
    return (
        screened.select(F.coalesce("language", F.lit("none")).alias("language"), F.explode_outer("hits").alias("h"))
        .filter("h is not null")
        .groupBy("language", F.col("h.family").alias("family"))
        .agg(F.count("*").alias("hits"), F.max("h.severity").alias("max_severity"))
    )


_FALLBACK_SQL = "CASE m.language WHEN 'de' THEN 'uz_latn' ELSE 'ru' END"


@query(
    "screen_all",
    f"""
    WITH sig AS (SELECT msg_id, string_agg(kind || ':' || note, ',' ORDER BY kind, note) AS signals FROM ({STRUCTURAL_SQL}) GROUP BY msg_id),
         hit AS (SELECT msg_id, string_agg(rule_id, ',' ORDER BY rule_order) AS rule_ids FROM rule_hits GROUP BY msg_id)
    SELECT m.msg_id, CASE WHEN length(m.text) = 0 THEN 'empty_input' END AS status, coalesce(rule_ids, '') AS rule_ids, coalesce(signals, '') AS signals,
      md5({_STRICT_SQL.replace("text", "m.text", 1)}) AS minimized,
      CASE WHEN len(regexp_extract_all(lower(m.text), '[a-zʼ'']+')) > 0 AND ({" OR ".join(f"contains(' ' || lower(m.text) || ' ', {quoted(x)})" for x in V.UZ_LATIN_MARKERS)})
           THEN 'uz_latn' ELSE {_FALLBACK_SQL} END AS reply_language
    FROM messages m LEFT JOIN hit USING (msg_id) LEFT JOIN sig USING (msg_id)""",
    ("messages", "normal", "rule_hits"),
)
def _(v: Views) -> DataFrame:
    # German texts count as sent by users of one reply language, all others have none of their own.
    own = v.messages.withColumn("language", F.when(F.col("language") == "de", "uz_latn"))
    pairs = F.array_sort(F.transform("signals", lambda s: F.concat_ws(":", s["kind"], F.coalesce(s["note"], F.lit("")))))
    return screen(own, v.patterns).select(
        "msg_id", "status", F.transform("hits", lambda h: h.rule_id).alias("rule_ids"), pairs.alias("signals"),
        F.md5("minimized").alias("minimized"), "reply_language",
    )
