"""Triage of messages and media, fixed replies, answers and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.operators.common import lookup_join
from wardline.functions.text import assemble_content, chatter_key, length_status, strip


def length_gate(messages: DataFrame, limit: int = V.MAX_TEXT_CHARS) -> DataFrame:
    """Adds ``status``: null, ``empty_input``, or the status for content that is too long."""
    return messages.withColumn(
        "status", length_status(F.col("text"), F.col("input_type"), limit)
    )


def flag_meta(
    messages: DataFrame, phrases: DataFrame, address_words: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``is_meta``: the message equals a chatter phrase once address and punctuation are gone."""
    known = phrases.select(F.col("phrase").alias("_key")).distinct().withColumn("_hit", F.lit(True))
    keyed = messages.withColumn("_key", chatter_key(F.col("text"), address_words))
    return (
        lookup_join(keyed, known, ["_key"], "left", F.monotonically_increasing_id())
        .withColumn("is_meta", F.coalesce("_hit", F.lit(False)))
        .drop("_key", "_hit")
    )


def without_meta(
    messages: DataFrame, phrases: DataFrame, address_words: tuple[str, ...] = ()
) -> DataFrame:
    """Messages that are situations to check."""
    return flag_meta(messages, phrases, address_words).filter("not is_meta").drop("is_meta")


def localize_status(results: DataFrame, copy: DataFrame) -> DataFrame:
    """Adds ``message`` from (status, language, message); unknown statuses use the media reply."""
    default = copy.filter(F.col("status") == "unsupported_media").select(
        "language", F.col("message").alias("_default")
    )
    spread = F.monotonically_increasing_id()
    named = lookup_join(results, copy.select("status", "language", "message"), ["status", "language"], "left", spread)
    return (
        lookup_join(named, default, ["language"], "left", spread)
        .withColumn("message", F.coalesce("message", "_default"))
        .drop("_default")
    )


def _section(title: Column, bullets: Column) -> Column:
    lines = F.transform(bullets, lambda b: F.concat(F.lit("- "), b))
    return F.concat(title, F.lit("\n"), F.array_join(lines, "\n"))


def _when_some(bullets: Column, block: Column) -> Column:
    return F.when(F.size(bullets) > 0, block)


def render_answer(drafts: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds ``answer``. ``headings``: language, red_flags_title, pattern_title, verify_title,
    ask_title, no_signal_text, limitation_text."""
    top = {
        c: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, V.MAX_BULLETS)
        for c in ("red_flags", "verify", "ask")
    }
    flags = _when_some(top["red_flags"], _section(F.col("red_flags_title"), top["red_flags"]))
    lead = F.when(F.col("no_signal"), F.col("no_signal_text")).otherwise(flags)
    pattern = F.when(
        F.coalesce("pattern", F.lit("")) != "", F.concat_ws(" ", "pattern_title", "pattern")
    )
    verify = _when_some(top["verify"], _section(F.col("verify_title"), top["verify"]))
    ask = _when_some(top["ask"], _section(F.col("ask_title"), top["ask"]))
    answer = F.concat_ws("\n\n", lead, pattern, verify, F.col("limitation_text"), ask)
    extra = [c for c in headings.columns if c != "language"]
    return drafts.join(headings, "language").withColumn("answer", answer).drop(*extra)


def json_string(text: Column) -> Column:
    """A JSON string literal, non-ASCII characters kept."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, 2, F.length(listed) - 2)


def json_list(items: Column) -> Column:
    quoted = F.array_join(F.transform(items, json_string), ", ")
    return F.concat(F.lit("["), quoted, F.lit("]"))


def _json_signal(s: Column) -> Column:
    note = F.concat(F.lit(', "note": '), json_string(s.note))
    return F.concat(
        F.lit('{"kind": '), json_string(s.kind), F.coalesce(note, F.lit("")), F.lit("}")
    )


#: Default block of a card; the wording of a product is the caller's.
CARD_TEMPLATE = "- card {id} v{version}\n  about: {mechanism}\n  flags: {red_flags}\n  checks: {verify_steps}\n  asks: {questions}"


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its places filled; braces inside values stay as they are."""
    pieces, rest = [], template
    while True:
        found = [(rest.find(place), place) for place in values if place in rest]
        if not found:
            return F.concat(*pieces, F.lit(rest))
        at, place = min(found)
        pieces += [F.lit(rest[:at]), values[place]]
        rest = rest[at + len(place):]


def _card_block(c: Column, template: str) -> Column:
    return _filled(
        template,
        {
            "{id}": c.id, "{version}": c.version, "{mechanism}": c.mechanism, "{red_flags}": json_list(c.red_flags),
            "{verify_steps}": json_list(c.verify_steps), "{questions}": json_list(c.questions),
        },
    )


def assemble_prompts(messages: DataFrame, template: str, card_template: str = CARD_TEMPLATE) -> DataFrame:
    """Adds ``prompt``. Needs language, minimized, hits (with ``desc``), signals and cards arrays.

    The template has the places {language}, {minimized_text}, {rule_hits}, {signals}, {knowledge}; that of a card {id},
    {version}, {mechanism}, {red_flags}, {verify_steps}, {questions}.
    """

    def hit_line(h: Column) -> Column:
        return F.concat(
            F.lit("- "), h.rule_id, F.lit(" | family="), h.family,
            F.lit(" | severity="), h.severity.cast("string"), F.lit(": "),
            F.coalesce(h["desc"], h.message_key),
        )

    def lines(items: str, render, separator: str, empty: str) -> Column:
        return F.when(F.size(items) == 0, F.lit(empty)).otherwise(
            F.array_join(F.transform(items, render), separator)
        )

    signals = F.concat(
        F.lit("["), F.array_join(F.transform("signals", _json_signal), ", "), F.lit("]")
    )
    values = {
        "{language}": F.col("language"),
        "{rule_hits}": lines("hits", hit_line, "\n", "- (none detected)"),
        "{signals}": signals,
        "{knowledge}": lines("cards", lambda c: _card_block(c, card_template), "\n", "- (none selected)"),
        "{minimized_text}": json_string(F.col("minimized")),
    }
    return messages.withColumn("prompt", _filled(template, values))


def select_ocr(
    candidates: DataFrame, min_confidence: float = V.OCR_MIN_CONFIDENCE
) -> DataFrame:
    """Best reading per image by characters times confidence; the earlier script wins a tie.

    ``candidates``: image_id, script_order, script, text, confidence.
    """
    score = F.length(strip(F.coalesce("text", F.lit("")))) * F.col("confidence")
    best = candidates.groupBy("image_id").agg(
        F.max_by(
            F.struct("script", "text", "confidence"),
            F.struct(score, -F.col("script_order")),
        ).alias("best")
    )
    chosen = best.select("image_id", "best.*").withColumn("text", strip(F.col("text")))
    unreadable = (F.col("text") == "") | (F.col("confidence") < min_confidence)
    return chosen.withColumn("status", F.when(unreadable, "low_ocr"))


def media_status(media: DataFrame, limit: int = V.MAX_TEXT_CHARS) -> DataFrame:
    """Adds ``status``, ``error_class`` and ``content`` to decoded media.

    ``media``: qr_count, qr_text, ocr_text, ocr_confidence, ocr_error, caption, raw_text. An OCR
    failure falls back to the QR text when there is one.
    """
    qr = F.when(F.col("qr_count") == 1, F.nullif(strip(F.col("qr_text")), F.lit("")))
    ocr = F.nullif(strip(F.coalesce("ocr_text", F.lit(""))), F.lit(""))
    unreadable = ocr.isNull() | (F.col("ocr_confidence") < V.OCR_MIN_CONFIDENCE)
    failed = F.col("ocr_error").isNotNull()
    failure = (
        F.when(F.col("ocr_error") == "timeout", "timeout")
        .when(F.col("ocr_error") == "invalid_image", "unsupported_media")
        .otherwise("ocr_error")
    )
    status = (
        F.when(F.col("qr_count") > 1, "low_ocr")
        .when(F.length(qr) > limit, "low_ocr")
        .when(failed & qr.isNull(), failure)
        .when(~failed & unreadable & qr.isNull(), "low_ocr")
    )
    error_class = F.when(F.col("qr_count") > 1, "MultipleQRCodes").when(
        F.length(qr) > limit, "QRPayloadTooLong"
    )
    readable = F.when(~failed & ~unreadable, ocr)
    content = assemble_content(F.col("caption"), F.col("raw_text"), readable, qr)
    return (
        media.withColumn("status", status)
        .withColumn("error_class", error_class)
        .withColumn("content", F.when(F.col("status").isNull(), content))
    )
