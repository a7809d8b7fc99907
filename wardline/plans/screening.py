"""The composed screening of a message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions import links as L
from wardline.functions.links import BASE_CATALOG, Catalog, LinkLabels
from wardline.functions.redact import minimize_answer, minimize_strict
from wardline.functions.signals import SIGNAL_TYPE, signal, structural_signals
from wardline.functions.text import length_status, resolve_language
from wardline.operators.common import INLINE_LIMIT, bounded_rows, content_key, lookup_join, stored
from wardline.operators.linkage import collect_catalog, listed_constant, listed_hashes, reputation_of_hashes, with_link_labels
from wardline.operators.retrieval import retrieve
from wardline.operators.rules import HIT_TYPE, with_normalized, with_rule_hits
from wardline.operators.triage import flag_meta

#: Rows of listed domain sets up to which they are broadcast; beyond, a salted join.
LISTED_LIMIT = 100_000
_FOUND = "struct<sources:array<string>,listed_since:date>"


def with_signals(messages: DataFrame, catalog: Catalog | LinkLabels = BASE_CATALOG) -> DataFrame:
    """Adds ``signals``: those of the rules, then the structural ones, then ``content_signals`` if there are any.

    Needs hits and normalized.
    """
    emitted = F.transform(
        F.filter("hits", lambda h: h.emits_signal.isNotNull()),
        lambda h: signal(h.emits_signal, h.family),
    ).cast(SIGNAL_TYPE)
    parts = [emitted, structural_signals(F.col("text"), F.col("normalized"), catalog).cast(SIGNAL_TYPE)]
    if "content_signals" in messages.columns:
        parts.append(F.coalesce(F.col("content_signals").cast(SIGNAL_TYPE), F.array().cast(SIGNAL_TYPE)))
    return messages.withColumn("signals", F.array_distinct(F.concat(*parts)))


def listed_note(sources: Column, since: Column) -> Column:
    """Note of a blocklist hit."""
    return F.concat(F.lit("listed by "), F.array_join(sources, ","), F.lit(" since "), since.cast("string"))


def with_reputation(
    messages: DataFrame, blocklist: DataFrame, id_col: str = "msg_id", note=listed_note, inline_limit: int = INLINE_LIMIT
) -> DataFrame:
    """Adds a blocklist hit behind ``hits`` where a domain of the text is listed.

    A list of at most ``inline_limit`` hashes sits in the plan and nothing is shuffled, which is the only way for a stream.
    For a longer one the different sets of domains, not the messages, meet the list, and the few sets that are listed come
    back by a broadcast when they are few, else by a salted join.
    """
    hashes = F.transform(L.message_domains(F.col("text")), L.hash_domain)
    rows = bounded_rows(listed_hashes(blocklist), inline_limit)
    if rows is None and messages.isStreaming:
        raise ValueError(f"a stream takes a blocklist of at most {inline_limit} hashes; screen its batches instead")

    def hit(sources: Column, since: Column) -> Column:
        return F.struct(
            F.lit(V.BLOCKLIST_RULE_ID).alias("rule_id"), F.lit(V.BLOCKLIST_FAMILY).alias("family"), note(sources, since).alias("message_key"),
            F.lit(V.BLOCKLIST_SEVERITY).alias("severity"), F.lit(None).cast("string").alias("emits_signal"),
        )

    if rows is not None:
        joined = messages.withColumn("_found", listed_constant(hashes, rows)) if rows else messages.withColumn("_found", F.lit(None).cast(_FOUND))
        joined = joined.withColumn("_listed", F.when(F.col("_found").isNotNull(), hit(F.col("_found.sources"), F.col("_found.listed_since")))).drop("_found")
    else:
        keyed = messages.withColumn("_hashes", hashes).withColumn("_set", content_key(F.col("_hashes")))
        sets = keyed.filter(F.size("_hashes") > 0).select("_set", "_hashes").dropDuplicates(["_set"])
        hashed = sets.select("_set", F.explode("_hashes").alias("domain_hash"))
        listed = reputation_of_hashes(hashed, blocklist, "_set").select("_set", hit(F.col("sources"), F.col("listed_since")).alias("_listed"))
        joined = lookup_join(keyed, stored(listed, "listed"), ["_set"], "left", F.col(id_col), LISTED_LIMIT).drop("_hashes", "_set")
    fresh = F.col("_listed").isNotNull() & ~F.exists("hits", lambda h: h.rule_id == F.col("_listed.rule_id"))
    hits = F.when(fresh, F.concat("hits", F.array("_listed").cast(HIT_TYPE))).otherwise(F.col("hits"))
    return joined.withColumn("hits", hits).drop("_listed")


def screen(
    messages: DataFrame,
    patterns: DataFrame,
    cards: DataFrame | None = None,
    blocklist: DataFrame | None = None,
    catalog: Catalog | dict[str, DataFrame] = BASE_CATALOG,
    fallback_language: str = "ru",
    id_col: str = "msg_id",
    phrases: DataFrame | None = None,
    address_words: tuple[str, ...] = (),
    limit: int | None = None,
    note=listed_note,
) -> DataFrame:
    """One row per message: status, language, hits, signals, redacted text, answer view and cards.

    Whole texts are screened whatever their length. ``status`` is null for a screened message, ``empty_input`` for one
    without text, ``meta`` for chatter (a phrase of ``phrases``), which gets no hits and no signals, and with a ``limit``
    the status for content that is longer; that one is a label only. Optional columns: ``language`` (fallback of the
    reply language if replies exist in it), ``detected`` and ``detected_probability`` of a language detector, and
    ``content_signals`` that came with the content. Without a blocklist, and with packs of moderate size, nothing is
    shuffled: the whole screening of a message happens in the task that read it. A ``catalog`` given as tables (brands,
    shorteners, suffixes) sits in the plan while each has few rows; else links are labelled in a table of their own.
    """
    text, columns = F.col("text"), messages.columns
    if isinstance(catalog, dict):
        small = collect_catalog(catalog["brands"], catalog["shorteners"], catalog["suffixes"])
        if small is None:
            messages = with_link_labels(messages, catalog, id_col, "_link_labels")
        catalog = LinkLabels(F.col("_link_labels")) if small is None else small
    status = length_status(text, F.col("input_type"), limit if limit is not None else 2**31 - 1)
    rows = messages.withColumn("status", status)
    if phrases is not None:
        flagged = flag_meta(rows, phrases, address_words)
        rows = flagged.withColumn("status", F.when(F.col("status").isNull() & F.col("is_meta"), "meta").otherwise(F.col("status")))
        rows = rows.drop("is_meta")
    fallback = F.lit(fallback_language)
    if "language" in columns:
        fallback = F.when(F.col("language").isin(*V.REPLY_LANGUAGES), F.col("language")).otherwise(fallback)
    detected = F.col("detected") if "detected" in columns else None
    probability = F.col("detected_probability") if "detected_probability" in columns else None
    matched = with_rule_hits(with_normalized(rows), patterns, id_col)
    if blocklist is not None:
        matched = with_reputation(matched, blocklist, id_col, note)
    checked = F.col("status").isNull() | (F.col("status") != "meta")
    matched = matched.withColumn("hits", F.when(checked, F.col("hits")).otherwise(F.array().cast(HIT_TYPE)))
    screened = with_signals(matched, catalog)
    screened = screened.withColumns(
        {
            "signals": F.when(checked, F.col("signals")).otherwise(F.array().cast(SIGNAL_TYPE)),
            "minimized": minimize_strict(text, catalog),
            "answer_view": minimize_answer(text, catalog),
            "reply_language": resolve_language(F.coalesce(text, F.lit("")), fallback, detected, probability),
        }
    )
    screened = screened.drop("_link_labels")
    return screened if cards is None else retrieve(screened, cards, id_col)
