"""Structural signals of a message, as boolean columns and as one array of (kind, note)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardline import fixed_values as V
from wardline.functions.links import BASE_CATALOG, Catalog, LinkLabels, find_spans, span_label
from wardline.functions.text import may_hold_card, may_hold_phone

SIGNAL_TYPE = "array<struct<kind:string,note:string>>"
_DIGITS = "[0-9]"


def has_email(text: Column) -> Column:
    return text.contains("@") & text.rlike(V.EMAIL)


def has_handle(text: Column) -> Column:
    return text.contains("@") & text.rlike(V.HANDLE)


def has_phone(text: Column) -> Column:
    return may_hold_phone(text) & text.rlike(V.PHONE)


def has_code(text: Column) -> Column:
    return text.rlike(r"(?U)\d{4}") & text.rlike(V.CODE_REQUEST)


def has_card(text: Column) -> Column:
    return may_hold_card(text) & text.rlike(V.CARD)


def has_transfer_near_card(normalized: Column) -> Column:
    """Transfer wording within 80 characters of a card-like run; wants normalised text."""
    return may_hold_card(normalized) & normalized.rlike(V.TRANSFER_NEAR_CARD)


def blank_emails(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, V.EMAIL, " ")).otherwise(text)


def signal(kind: Column | str, note: Column | str | None = None) -> Column:
    def as_text(value: Column | str | None) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(as_text(kind).alias("kind"), as_text(note).alias("note"))


def link_signals(text: Column, catalog: Catalog | LinkLabels = BASE_CATALOG) -> Column:
    """One signal per link outside e-mail addresses; the note names the shape."""
    kinds = F.create_map(*[F.lit(x) for pair in V.SIGNAL_KIND_BY_LABEL.items() for x in pair])

    def as_signal(label: Column) -> Column:
        return signal(F.coalesce(kinds[label], F.lit("link")), label)

    labels = F.transform(find_spans(blank_emails(text)), lambda u: span_label(u, catalog))
    return F.transform(labels, as_signal)


def structural_signals(
    text: Column, normalized: Column, catalog: Catalog | LinkLabels = BASE_CATALOG
) -> Column:
    """All structural facts of a message, unique by (kind, note), in a fixed order."""
    found = F.array_compact(
        F.array(
            F.when(has_email(text), signal("email")),
            F.when(has_handle(text), signal("handle")),
            F.when(has_phone(text), signal("phone")),
            F.when(has_code(text), signal("code")),
            F.when(has_card(text), signal("card")),
            F.when(has_transfer_near_card(normalized), signal("card_personal", V.TRANSFER_NOTE)),
        )
    )
    return F.array_distinct(F.concat(link_signals(text, catalog), found))
