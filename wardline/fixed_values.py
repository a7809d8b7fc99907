"""Enumerations, word lists, patterns and constants.

Everything in this module is data that has to have exactly this value for results to be right.
Patterns are written for ``java.util.regex``; the ``U`` flag makes ``\\w \\d \\s \\b`` Unicode-aware.
"""

# --- Fixed values: limits -----------------------------------------------------------------------
MAX_TEXT_CHARS = 6000
MAX_BULLETS = 3
MAX_CARDS = 3
MAX_SHARE_FAMILIES = 3
RED_FLAG_MIN_SEVERITY = 2
OCR_MIN_CONFIDENCE = 0.5
DETECTOR_MIN_PROBABILITY = 0.75
DAILY_LIMIT = 5
WORDS_PER_MINUTE = 180
ALERT_DEBOUNCE_SECONDS = 900
CANDIDATE_MIN_SAMPLES = 5
CANDIDATE_GAP = 0.15
KB_VERSION_MAX_CHARS = 80
USER_KEY_LENGTH = 32

# --- Fixed values: enumerations -----------------------------------------------------------------
REPLY_LANGUAGES = ("uz_latn", "ru")
PATTERN_LANGUAGES = ("uz_latn", "uz_cyrl", "ru")
INPUT_TYPES = ("text", "image")
STATUSES = (
    "ok", "no_signal", "empty_input", "meta", "off_topic", "low_ocr", "rate_limited", "timeout",
    "llm_error", "ocr_error", "safety_fallback", "unsupported_media",
)
COMPLETED_STATUSES = ("ok", "no_signal")
BILLABLE_STATUSES = ("ok", "no_signal", "low_ocr", "off_topic", "safety_fallback")
USEFULNESS_VALUES = ("yes", "partly", "no")
USEFUL_VALUES = ("yes", "partly")
NEXT_ACTION_VALUES = ("verify", "delay_stop", "continue", "not_sure")
RATE_LIMIT_SCOPES = ("user", "web_ip")
RETRIEVAL_MODES = ("rule", "signal", "cue", "router", "none")
RETRIEVAL_STATUSES = ("ok", "empty", "unavailable")
ROUTER_STATUSES = ("not_used", "ok", "unavailable", "invalid_ids")
CARD_STATUSES = ("approved", "draft", "retired")
POST_CATEGORIES = ("payments", "phishing", "marketplace", "jobs", "accounts", "documents")
POST_STATES = ("draft", "published")
PAGED_STAGES = ("ocr", "llm", "web", "bot", "knowledge", "url_reputation")

# --- Fixed values: identifier shapes ------------------------------------------------------------
ID_SHAPE = r"^[a-z][a-z0-9_.-]{0,79}$"
VERSION_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,79}$"
ERROR_CLASS_SHAPE = r"^[A-Za-z_][A-Za-z0-9_]{0,79}$"
RULE_ID_SHAPE = r"^[a-z][a-z0-9]*(?:\.[a-z0-9_]+)+$"
CARD_ID_SHAPE = r"^[a-z][a-z0-9_]*(?:\.[a-z0-9_]+)+$"
CARD_VERSION_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,39}$"
SNAKE_SHAPE = r"^[a-z][a-z0-9_]*$"
SLUG_SHAPE = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
REQUEST_ID_SHAPE = r"^[0-9a-f]{32}$"
REGEX_PREFIX = "regex:"
BLOCKLIST_RULE_ID = "shared.link.blocklisted"
BLOCKLIST_FAMILY = "suspicious_link_qr"
BLOCKLIST_SEVERITY = 3

# --- Fixed values: caps on operator-written rules, cards and posts --------------------------------
RULE_DESCRIPTION_MAX = 400
RULE_PATTERN_MAX = 120
RULE_PATTERNS_PER_LANGUAGE = 60
RULE_LITERAL_MIN = 3
CARD_REVIEWER_MAX = 120
CARD_MECHANISM_MAX = 600
CARD_ENTRY_MAX = 400
CARD_ENTRIES = 12
CARD_ALIAS_MAX = 120
CARD_ALIASES_PER_LANGUAGE = 40
POST_SLUG_MAX = 100
POST_TITLE_MAX = 160
POST_SUMMARY_MAX = 320
POST_ARTICLE_MAX = 12000

# --- Fixed values: text normalisation -----------------------------------------------------------
APOSTROPHE_VARIANTS = "’‘`ʼ՚´"
ODD_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"  # what NFKC leaves besides the plain space
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# --- Fixed values: links ------------------------------------------------------------------------
URL = (
    r"(?iU)\b(?:https?|hxxps?)://[^\s<>()]+"
    r"|\b(?:www\.)?[a-z0-9\u0080-\uffff][a-z0-9\u0080-\uffff.-]*"
    r"(?:\.|\[\.\]|\(\.\))[a-z\u0080-\uffff]{2,}(?:/[^\s<>()]*)?"
)
FEED_CANDIDATE = (
    r"(?iU)(?:hxxps?|https?)://[^,\s\"']+|(?:www\.)?[a-z0-9.-]+\.[a-z]{2,}"
)
TRAILING_PUNCTUATION = r""".,;:!?)\]}"'"""
LABEL_SHORTENED = "shortened"
LABEL_LOOKALIKE = "lookalike-domain"
LABEL_DOMAIN_IN_SUBDOMAIN = "domain-in-subdomain"
LABEL_MIXED_SCRIPT = "mixed-script-domain"
LABEL_CREDENTIALS = "credentials-in-url"
LABEL_IP = "ip-address"
SIGNAL_KIND_BY_LABEL = {
    "shortened": "link_shortened",
    "lookalike-domain": "link_lookalike",
    "domain-in-subdomain": "link_lookalike",
    "mixed-script-domain": "link_lookalike",
    "credentials-in-url": "link_userinfo",
    "ip-address": "link_ip",
}
CONFUSABLE_LETTERS = "авеёкмнорстухіјѕԁһԛԝ" "αεικνορτυχ"
CONFUSABLE_ASCII = "abeekmhopctyxijsdhqw" "aeikvoptux"
BRAND_DOMAINS = {
    "agrobank": ("agrobank.uz",),
    "anorbank": ("anorbank.uz",),
    "beeline": ("beeline.uz",),
    "click": ("click.uz",),
    "hamkorbank": ("hamkorbank.uz",),
    "humo": ("humocard.uz", "humo.uz"),
    "ipoteka": ("ipotekabank.uz",),
    "kapitalbank": ("kapitalbank.uz",),
    "olx": ("olx.uz",),
    "payme": ("payme.uz",),
    "telegram": ("telegram.org", "t.me"),
    "uzcard": ("uzcard.uz",),
    "uzum": ("uzum.uz", "uzumbank.uz"),
    "xalqqbank": ("xb.uz",),
}
SHORTENERS = (
    "bit.ly", "clck.ru", "cutt.ly", "goo.gl", "is.gd", "lnkd.in", "ow.ly", "s.id", "shorturl.at",
    "t.co", "tiny.cc", "tinyurl.com",
)
NESTED_SUFFIXES = ("uz", "com", "net", "org", "ru")
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV6 = (
    r"(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,7}:|::"
    r"|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,1}|(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}"
    r"|(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}|(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}"
    r"|(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}|[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}"
    r"|:(?::[0-9a-f]{1,4}){1,7})"
)

# --- Fixed values: structural signals and redaction ---------------------------------------------
EMAIL = r"(?iU)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
TME = r"(?iU)\b(?:https?|hxxps?)://t\.me/[a-z0-9_]{4,32}\b"
HANDLE = r"(?iU)(?<!\w)@[a-z0-9_]{4,32}\b"
PHONE = (
    r"(?U)(?<!\d)(?:\+\d{1,3}(?:[\s().-]*\d){6,14}"
    r"|(?:\+?998[\s().-]?)?(?:\(?[2-9]\d\)?[\s().-]?)\d{3}[\s().-]?\d{2}[\s().-]?\d{2})(?!\d)"
)
CODE_REQUEST = r"(?iU)\b(?:sms\s*)?(?:otp|kod|code|код|парол|password)[^\d]{0,20}(\d{4,8})(?!\d)"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
TRANSFER_NEAR_CARD = (
    r"(?iU)(?:karta|карта|card|перевод|perevod|o'tkaz|ўтказ|tashla|ташла|qaytar|қайтар)"
    r".{0,80}(?:\d[ -]?){13,19}"
    r"|(?:\d[ -]?){13,19}.{0,80}"
    r"(?:karta|карта|card|перевод|perevod|o'tkaz|ўтказ|tashla|ташла|qaytar|қайтар)"
)
TRANSFER_NOTE = "transfer-to-card phrasing"
SECRET_VALUE = (
    r"(?iU)\b((?:password|parol|пароль?)(?:\s+(?:is|bu|это))?[ \t:=\-–—]{1,10})(\S{3,128})"
)
CODE_VALUE = (
    r"(?iU)\b((?:sms\s*)?(?:otp|kod|code|код|parol|пароль?|password)[^\d]{0,20})(\d{4,8})(?!\d)"
)
PASSPORT = r"(?iU)(?<![a-z0-9])(?:[a-z]{2}\s?\d{7})(?![a-z0-9])"
ADDRESS = (
    r"(?iU)\b(?:ko['‘’]chasi|кучаси|кўчаси|улица|ул\.|street|st\.)"
    r"\s+[^\n,.;]{2,50}\d*"
)
NAME = (
    r"(?U)(?<![\w\[])(?:[A-ZА-ЯЁЎҚҒҲ][a-zа-яёўқғҳ']{2,}\s+){1,2}"
    r"[A-ZА-ЯЁЎҚҒҲ][a-zа-яёўқғҳ']{2,}(?![\w\]])"
)
REDACTION_TOKENS = (
    "EMAIL", "HANDLE", "LINK", "PHONE", "SECRET", "CODE", "PASSPORT", "CARD", "ADDRESS", "NAME",
)

# --- Fixed values: language resolution ----------------------------------------------------------
CYRILLIC_WORD = r"[Ѐ-ӿ]+"
LATIN_WORD = r"[A-Za-zʼ']+"
UZ_CYRILLIC_LETTER = r"[ЎўҒғҚқҲҳ]"
UZ_LATIN_MARKERS = (
    " o'", " g'", " sh", " ch", " xavf", " yubor", " tekshir", " so'm", " to'lov", " bugun",
    " hozir", " uchun", " kart", " hisob",
)
UZ_CYRILLIC_WORDS = (
    "хавф", "текшир", "юбор", "учун", "бугун", "ҳозир", "тўлов", "сўм", "карта",
)

# --- Fixed values: event-log contract -----------------------------------------------------------
EVENT_NAMES = (
    "consent_shown", "consent_accepted", "check_started", "check_completed", "check_failed",
    "usefulness_answered", "decision_answered", "share_clicked", "share_tapped",
    "deletion_requested", "deletion_completed", "rule_pack_refreshed", "knowledge_base_refreshed",
)
EVENT_FIELDS = (
    "active_cards", "active_rules", "baseline_cards", "baseline_rules", "cost_usd", "error_class",
    "input_tokens", "input_type", "kb_version", "knowledge_card_ids", "language", "latency",
    "latency_ms", "limit", "llm_ms", "next_action", "disabled_rules", "no_signal",
    "ocr_confidence", "ocr_ms", "output_tokens", "override_cards", "override_rules",
    "retrieval_mode", "retrieval_status", "router_status", "reviewed_case_ids", "rule_ids",
    "safety_blocked", "status", "suppressed_cards", "tokens", "usefulness",
)
CONTENT_LIKE_TOKENS = (
    "body", "caption", "card", "contact", "content", "email", "file", "image", "link", "message",
    "name", "ocr_text", "password", "phone", "prompt", "raw", "secret", "text", "url", "username",
)
CONTENT_LIKE_EXEMPT = (
    "knowledge_card_ids", "active_cards", "baseline_cards", "override_cards", "suppressed_cards",
)
ERROR_STAGES = (
    "ocr", "qr", "llm", "validate", "web", "bot", "knowledge", "rule_pack", "url_reputation",
)
ERROR_FIELDS = (
    "attempt", "reason", "status_code", "timeout_s", "rate", "checks", "window_minutes",
)
LEAK_PATTERNS = {
    "email": r"(?iU)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "url": r"(?iU)\b(?:https?|hxxps?)://[^\s<>()]+|\bwww\.[^\s<>()]+",
    "phone": r"(?U)(?<!\d)(?:\+?\d[\d\s().-]{6,}\d)(?!\d)",
    "card": r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
    "passport": r"(?iU)(?<![a-z0-9])(?:[a-z]{2}\s?\d{7})(?![a-z0-9])",
}
STRICT_SHAPES = {"kb_version": VERSION_SHAPE, "request_id": REQUEST_ID_SHAPE}
