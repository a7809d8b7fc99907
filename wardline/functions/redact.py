"""Redaction: fixed-order token replacement, strict view and answer view of a message."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardline import fixed_values as V
from wardline.functions.links import (
    BASE_CATALOG,
    Catalog,
    LinkLabels,
    find_spans,
    may_hold_link,
    span_label,
    trim_trailing,
)
from wardline.functions.text import bind, may_hold_card, may_hold_phone


def _where(guard: Column, text: Column, replaced: Column) -> Column:
    return F.when(guard, replaced).otherwise(text)


def redact_email(text: Column) -> Column:
    return _where(text.contains("@"), text, F.regexp_replace(text, V.EMAIL, "[EMAIL]"))


def redact_tme(text: Column) -> Column:
    return _where(text.contains("://"), text, F.regexp_replace(text, V.TME, "[HANDLE]"))


def redact_link(text: Column, catalog: Catalog | LinkLabels = BASE_CATALOG) -> Column:
    """``[LINK]`` or ``[LINK: label]`` for each link, keeping the punctuation after it."""

    def token(span: Column) -> Column:
        def render(core: Column) -> Column:
            label = span_label(core, catalog)
            mark = F.coalesce(
                F.concat(F.lit("[LINK: "), label, F.lit("]")), F.lit("[LINK]")
            )
            return F.concat(mark, F.substring(span, F.length(core) + 1, F.length(span)))

        return bind(trim_trailing(span), render)

    return _where(
        may_hold_link(text), text, _weave(F.split(text, V.URL, -1), F.transform(find_spans(text), token))
    )


def _weave(gaps: Column, spans: Column) -> Column:
    """Gap, span, gap, span, ..., gap as one string; there is one more gap than spans."""
    pieces = F.zip_with(gaps, spans, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    return F.array_join(pieces, "")


def redact_handle(text: Column) -> Column:
    return _where(text.contains("@"), text, F.regexp_replace(text, V.HANDLE, "[HANDLE]"))


def redact_phone(text: Column) -> Column:
    return _where(may_hold_phone(text), text, F.regexp_replace(text, V.PHONE, "[PHONE]"))


def redact_secret(text: Column) -> Column:
    return F.regexp_replace(text, V.SECRET_VALUE, "$1[SECRET]")


def redact_code(text: Column) -> Column:
    return _where(text.rlike(r"(?U)\d{4}"), text, F.regexp_replace(text, V.CODE_VALUE, "$1[CODE]"))


def redact_passport(text: Column) -> Column:
    return _where(text.rlike(r"(?U)\d{7}"), text, F.regexp_replace(text, V.PASSPORT, "[PASSPORT]"))


def redact_card(text: Column) -> Column:
    return _where(may_hold_card(text), text, F.regexp_replace(text, V.CARD, "[CARD]"))


def redact_address(text: Column) -> Column:
    return F.regexp_replace(text, V.ADDRESS, "[ADDRESS]")


def redact_name(text: Column) -> Column:
    return F.regexp_replace(text, V.NAME, "[NAME]")


def minimize_strict(
    text: Column, catalog: Catalog | LinkLabels = BASE_CATALOG, preserve_names: bool = False
) -> Column:
    """Every replacer in its fixed order. Each step is bound, so nothing is evaluated twice."""
    steps = [
        redact_email,
        redact_tme,
        lambda t: redact_link(t, catalog),
        redact_handle,
        redact_phone,
        redact_secret,
        redact_code,
        redact_passport,
        redact_card,
        redact_address,
    ]
    if not preserve_names:
        steps.append(redact_name)
    for step in steps:
        text = bind(text, step)
    return text


def _answer_parts(text: Column) -> Column:
    """struct(done: gaps and the spans behind them, open: the last gap).

    A span right after "@" is the domain of an e-mail address: it goes back into the gap.
    """
    pairs = F.zip_with(
        F.split(text, V.URL, -1),
        find_spans(text),
        lambda g, s: F.struct(g.alias("gap"), s.alias("span")),
    )
    start = F.struct(
        F.array().cast("array<struct<gap:string,span:string>>").alias("done"),
        F.lit("").alias("open"),
    )
    return F.aggregate(
        pairs,
        start,
        lambda acc, p: bind(
            F.concat(acc.open, p.gap),
            lambda gap: F.when(
                p.span.isNotNull() & p.gap.endswith("@"),
                F.struct(acc.done.alias("done"), F.concat(gap, p.span).alias("open")),
            ).otherwise(
                F.struct(
                    F.concat(acc.done, F.array(F.struct(gap.alias("gap"), p.span.alias("span")))).alias("done"),
                    F.lit("").alias("open"),
                )
            ),
        ),
    )


def minimize_answer(text: Column, catalog: Catalog | LinkLabels = BASE_CATALOG) -> Column:
    """Names and links stay as written; everything else between links is redacted."""

    def around(parts: Column) -> Column:
        cleaned = F.transform(
            parts.done,
            lambda p: F.concat(minimize_strict(p.gap, catalog, preserve_names=True), F.coalesce(p.span, F.lit(""))),
        )
        return F.concat(F.array_join(cleaned, ""), minimize_strict(parts.open, catalog, preserve_names=True))

    return bind(text, lambda t: bind(_answer_parts(t), around))


def labelled_links(text: Column) -> Column:
    """Distinct links, without trailing punctuation, whose labels signals, redaction and the answer view may ask for."""

    def left(t: Column) -> Column:
        return find_spans(bind(redact_email(t), redact_tme))

    def spans(t: Column) -> Column:
        blanked = F.when(t.contains("@"), F.regexp_replace(t, V.EMAIL, " ")).otherwise(t)
        gaps = bind(_answer_parts(t), lambda p: F.flatten(F.transform(F.concat(F.transform(p.done, lambda d: d.gap), F.array(p.open)), left)))
        return F.array_distinct(F.transform(F.concat(find_spans(blanked), left(t), gaps), trim_trailing))

    return F.when(may_hold_link(text), bind(text, spans)).otherwise(F.array().cast("array<string>"))


def redaction_counts(minimized: Column) -> Column:
    """struct with one count per token kind found in redacted text."""
    shapes = {t: rf"\[{t}\]" for t in V.REDACTION_TOKENS} | {"LINK": r"\[LINK(?:: [a-z-]+)?\]"}
    return bind(
        minimized,
        lambda text: F.struct(
            *[F.regexp_count(text, F.lit(p)).alias(t.lower()) for t, p in shapes.items()]
        ),
    )
