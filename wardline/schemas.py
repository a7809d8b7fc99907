"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

MESSAGES = "msg_id bigint, user_key string, language string, input_type string, text string, caption string"
CHECK_EVENT = (
    "id string, user_key string, ts timestamp, input_type string, language string, "
    "rule_ids array<string>, knowledge_card_ids array<string>, reviewed_case_ids array<string>, "
    "retrieval_mode string, retrieval_status string, router_status string, kb_version string, "
    "no_signal boolean, status string, error_class string, ocr_confidence double, latency_ms int, "
    "ocr_ms int, llm_ms int, input_tokens int, output_tokens int, cost_usd decimal(10,6), "
    "safety_blocked boolean"
)
CONSENT = "user_key string, notice_version string, language string, ts timestamp"
FEEDBACK = "check_id string, usefulness string, next_action string, ts timestamp"
RATE_LIMIT = "user_key string, scope string, day date, count int"
DELETION_LOG = "id string, user_key string, requested_ts timestamp, completed_ts timestamp"
STORY_SUBMISSION = (
    "id string, user_key string, language string, minimized_text string, status string, "
    "created_ts timestamp, reviewed_ts timestamp"
)
URL_BLOCKLIST = "domain_hash string, source string, first_seen timestamp, last_seen timestamp"
RULES = (
    "rule_order bigint, rule_id string, family string, desc string, message_key string, "
    "severity int, emits_signal string, match map<string,array<string>>"
)
RULE_OVERRIDES = (
    "rule_id string, family string, desc string, message_key string, severity int, "
    "emits_signal string, match map<string,array<string>>, disabled boolean, updated_ts timestamp"
)
CARDS = (
    "id string, version string, status string, reviewer string, trigger_rule_ids array<string>, "
    "trigger_signal_kinds array<string>, retrieval_aliases map<string,array<string>>, "
    "mechanism string, red_flags array<string>, verify_steps array<string>, "
    "questions array<string>, reviewed_case_ids array<string>"
)
CARD_OVERRIDES = CARDS + ", updated_ts timestamp"
BRANDS = "brand string, domain string"
SHORTENERS = "domain string"
NESTED_SUFFIXES = "label string"
DRAFTS = (
    "check_id string, language string, red_flags array<string>, pattern string, "
    "verify array<string>, ask array<string>, addressed_rule_ids array<string>, "
    "hits array<struct<rule_id:string,severity:int>>, knowledge_card_ids array<string>"
)
ERRORS = "stage string, error_type string, ts timestamp"
LOG_EVENTS = "request_id string, event string, error_type string, ts timestamp"
