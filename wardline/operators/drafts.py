"""Quality checks of model-written drafts and the outcome of a check."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from wardline import draft_values as D, fixed_values as V
from wardline.functions.text import any_of, casefold, normalize_output
from wardline.operators.common import first_failure, lookup_join

_STRINGS = "array<string>"
_HITS = "array<struct<rule_id:string,severity:int>>"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_STRINGS))


def truncate_drafts(drafts: DataFrame) -> DataFrame:
    """Cuts the three blocks to three entries each."""
    for block in ("red_flags", "verify", "ask"):
        drafts = drafts.withColumn(block, F.slice(_list(block), 1, V.MAX_BULLETS))
    return drafts


def joined_text() -> Column:
    """Everything a reader would see of a draft, one entry per line."""
    parts = F.concat("red_flags", F.array(F.coalesce("pattern", F.lit(""))), "verify", "ask")
    text = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def banned_word(lowered: Column) -> Column:
    """A banned verdict word standing on its own; wants case-folded text."""
    words = "|".join(re.escape(w.casefold()) for w in D.BANNED_WORDS)
    return lowered.rlike(rf"(?U)(?<![\w-])(?:{words})(?![\w-])")


def payment_confirmed(text: Column) -> Column:
    """A sentence that states an incoming payment as fact, without disclaiming it."""
    return F.exists(
        F.split(text, D.SENTENCE_BREAK, -1),
        lambda s: _matches(s, D.PAYMENT_CONFIRMED) & ~s.rlike(D.PAYMENT_DISCLAIMER),
    )


def lookup_patterns(self_names: tuple[str, ...] = ()) -> tuple[str, ...]:
    extra = "".join(f"|{re.escape(n)}" for n in self_names)
    return tuple(p.replace("{self_name}", extra) for p in D.EXTERNAL_LOOKUPS)


def text_failures(
    scan: Column, lowered: Column, card_ids: Column, listed: Column, self_names: tuple[str, ...] = ()
) -> dict[str, Column]:
    """Reason -> condition under which the text of a draft fails, in the order they count."""
    phone_text = F.when(listed, F.regexp_replace(scan, D.ISO_DATE, "[DATE]")).otherwise(scan)
    return {
        D.REASON_BANNED_WORD: banned_word(lowered),
        D.REASON_DIRECT_VERDICT: _matches(scan, D.DIRECT_VERDICTS),
        D.REASON_RISK_SCORE: _matches(scan, D.RISK_SCORES),
        D.REASON_CONTACT_OR_URL: scan.rlike(V.EMAIL) | scan.rlike(D.URL_OR_DOMAIN),
        D.REASON_PHONE: phone_text.rlike(D.CONTACT_PHONE),
        D.REASON_CARD: scan.rlike(V.CARD),
        D.REASON_PASSPORT: scan.rlike(V.PASSPORT),
        D.REASON_SECRET: scan.rlike(D.LABELLED_OTP) | scan.rlike(D.PASSWORD_VALUE),
        D.REASON_UNSAFE: _matches(scan, D.UNSAFE_INSTRUCTIONS),
        D.REASON_INTERNAL_ID: scan.rlike(D.INTERNAL_ID)
        | F.exists(card_ids, lambda i: F.contains(lowered, casefold(i))),
        D.REASON_PAYMENT: payment_confirmed(scan),
        D.REASON_CASE_PROOF: _matches(scan, D.CASE_AS_PROOF),
        D.REASON_EXTERNAL_LOOKUP: _matches(scan, lookup_patterns(self_names)),
        D.REASON_BLOCKLIST: scan.rlike(D.BLOCKLIST_CLAIM) & ~listed,
    }


def draft_qa(drafts: DataFrame, self_names: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``reason`` (first that applies, in order), ``ok`` and ``no_signal``; cuts the blocks.

    Needs language, red_flags, pattern, verify, ask, addressed_rule_ids, ``hits`` (rule_id, severity)
    and ``knowledge_card_ids``.
    """
    hits = F.coalesce(F.col("hits"), F.array().cast(_HITS))
    known = F.transform(hits, lambda h: h.rule_id)
    grave = F.filter(hits, lambda h: h.severity >= V.RED_FLAG_MIN_SEVERITY)
    required = F.transform(grave, lambda h: h.rule_id)
    scanned = (
        truncate_drafts(drafts)
        .withColumn("_scan", normalize_output(joined_text()))
        .withColumn("_lower", casefold(F.col("_scan")))
    )
    scan = F.col("_scan")
    listed = F.array_contains(known, V.BLOCKLIST_RULE_ID)
    failures = text_failures(scan, F.col("_lower"), _list("knowledge_card_ids"), listed, self_names)
    addressed = _list("addressed_rule_ids")
    failures |= {
        D.REASON_SCRIPT: (F.col("language") == "uz_latn") & scan.rlike(D.CYRILLIC_LETTER),
        D.REASON_VERIFY_EMPTY: F.size("verify") == 0,
        D.REASON_ASK_EMPTY: F.size("ask") == 0,
        D.REASON_RED_FLAGS_EMPTY: (F.size(grave) > 0) & (F.size("red_flags") == 0),
        D.REASON_UNKNOWN_RULES: F.size(F.array_except(addressed, known)) > 0,
        D.REASON_MISSING_RULES: F.size(F.array_except(required, addressed)) > 0,
    }
    reason = first_failure({name: ~failed for name, failed in failures.items()})
    return (
        scanned.withColumn("reason", reason)
        .withColumn("ok", F.col("reason").isNull())
        .withColumn("no_signal", (F.size(hits) == 0) & (F.size("red_flags") == 0))
        .drop("_scan", "_lower")
    )


def draft_flags(drafts: DataFrame, self_names: tuple[str, ...] = ()) -> DataFrame:
    """One boolean column per text check instead of only the first that applies."""
    hits = F.coalesce(F.col("hits"), F.array().cast(_HITS))
    listed = F.exists(hits, lambda h: h.rule_id == V.BLOCKLIST_RULE_ID)
    scanned = (
        truncate_drafts(drafts)
        .withColumn("_scan", normalize_output(joined_text()))
        .withColumn("_lower", casefold(F.col("_scan")))
    )
    failures = text_failures(
        F.col("_scan"), F.col("_lower"), _list("knowledge_card_ids"), listed, self_names
    )
    named = {re.sub(r"[^a-z]+", "_", k.lower()): v for k, v in failures.items()}
    return scanned.withColumns(named).drop("_scan", "_lower")


def rejection_breakdown(judged: DataFrame) -> DataFrame:
    """Rejected drafts per reason and language."""
    return (
        judged.filter("not ok").groupBy("reason", "language").agg(F.count("*").alias("drafts"))
    )


def resolve_attempts(attempts: DataFrame, id_col: str = "check_id", limit: int = 2) -> DataFrame:
    """One row per check from its first ``limit`` attempts: the first accepted one wins.

    Tokens add up over the attempts that were really made, that is up to the winner. Aggregates
    only, so any number of attempt rows per check combines before the shuffle.
    """
    made = attempts.filter(F.col("attempt") <= limit)
    winner = F.min(F.when(F.col("ok"), F.col("attempt")))
    by_attempt = made.groupBy(id_col, "attempt").agg(
        F.bool_or("ok").alias("ok"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min_by("reason", F.col("reason")).alias("reason"),
    )
    per_check = by_attempt.groupBy(id_col).agg(
        winner.alias("winner"),
        F.max_by("reason", "attempt").alias("last_reason"),
        F.collect_list(F.struct("attempt", "input_tokens", "output_tokens")).alias("spent"),
    )

    def total(field: str) -> Column:
        counted = F.filter(
            "spent", lambda s: F.col("winner").isNull() | (s.attempt <= F.col("winner"))
        )
        return F.aggregate(counted, F.lit(0).cast("long"), lambda acc, s: acc + s[field])

    return per_check.select(
        id_col,
        F.when(F.col("winner").isNull(), "safety_fallback").otherwise("ok").alias("outcome"),
        "winner",
        F.when(F.col("winner").isNull(), F.col("last_reason")).alias("reason"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
    )


def check_status(stages: DataFrame) -> DataFrame:
    """Adds the terminal ``status`` of a check from the results of its stages.

    ``stages``: rate_limited, media_status, length_status, is_meta, model_error (timeout,
    llm_error or null), situation_type, rule_hit_count, outcome, red_flag_count.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(yes("rate_limited"), "rate_limited")
        .when(F.col("media_status").isNotNull(), F.col("media_status"))
        .when(F.col("length_status").isNotNull(), F.col("length_status"))
        .when(yes("is_meta"), "meta")
        .when(F.col("model_error").isNotNull(), F.col("model_error"))
        .when((F.col("situation_type") == "off_topic") & (F.col("rule_hit_count") == 0), "off_topic")
        .when(F.col("outcome") == "safety_fallback", "safety_fallback")
        .when((F.col("rule_hit_count") == 0) & (F.col("red_flag_count") == 0), "no_signal")
        .otherwise("ok")
    )
    return stages.withColumn("status", status)


def billable(status: Column) -> Column:
    """Whether a status uses up one slot of the daily quota."""
    return status.isin(*V.BILLABLE_STATUSES)


def token_cost(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``cost_usd`` from token counts and the per-million rates of each model."""
    dec = "decimal(20,10)"
    cost = (
        F.col("input_tokens").cast("decimal(20,0)") * F.col("in_rate_per_m").cast(dec)
        + F.col("output_tokens").cast("decimal(20,0)") * F.col("out_rate_per_m").cast(dec)
    ) / F.lit(1000000).cast("decimal(10,0)")
    prices = rates.select("model", "in_rate_per_m", "out_rate_per_m")
    priced = lookup_join(events, prices, ["model"], "left", F.struct("input_tokens", "output_tokens"))
    return priced.withColumn("cost_usd", F.round(cost, 6).cast("decimal(18,6)")).drop(
        "in_rate_per_m", "out_rate_per_m"
    )
