"""Where retrieval of guidance cards missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators.common import in_window, rate


def _retrieved(events: DataFrame, since: str | None, until: str | None) -> DataFrame:
    return events.filter(
        F.col("retrieval_status").isNotNull() & in_window(F.col("ts"), since, until)
    )


def gap_coverage(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Per language: checks, found, unrounded coverage, no match, unavailable."""
    found = F.size(F.coalesce("knowledge_card_ids", F.array())) > 0
    out = ~found & (F.col("retrieval_status") == "unavailable")
    return (
        _retrieved(events, since, until)
        .groupBy("language")
        .agg(
            F.count("*").alias("checks"),
            F.count_if(found).alias("found"),
            F.count_if(~found & ~out).alias("no_match"),
            F.count_if(out).alias("unavailable"),
        )
        .withColumn("coverage_rate", rate(F.col("found"), F.col("checks"), digits=None))
    )


def gap_groups(
    events: DataFrame, feedback: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    """(language, rule_ids, count): empty retrievals rated ``no``, most frequent first."""
    missed = _retrieved(events, since, until).filter(F.col("retrieval_status") == "empty")
    unhappy = feedback.filter(F.col("usefulness") == "no").select(F.col("check_id").alias("id"))
    sorted_ids = F.sort_array(F.coalesce("rule_ids", F.array().cast("array<string>")))
    return (
        missed.join(unhappy, "id", "left_semi")
        .groupBy("language", sorted_ids.alias("rule_ids"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "language", "rule_ids")
    )


def _used(events: DataFrame, since: str | None, until: str | None) -> DataFrame:
    return (
        _retrieved(events, since, until)
        .select(F.explode("knowledge_card_ids").alias("card_id"))
        .groupBy("card_id")
        .agg(F.count("*").alias("count"))
    )


def _approved(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("status") == "approved").select(F.col("id").alias("card_id")).distinct()


def card_usage(
    events: DataFrame, cards: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    """(card_id, count): used cards, approved or not, and approved cards never used."""
    return (
        _used(events, since, until)
        .join(_approved(cards), "card_id", "full")
        .select("card_id", F.coalesce("count", F.lit(0)).alias("count"))
    )


def unused_cards(
    events: DataFrame, cards: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    return _approved(cards).join(_used(events, since, until), "card_id", "left_anti")


def router_health(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(key, count) with keys ``mode:x`` and ``status:y``; unused routers are not counted."""
    used = F.when(F.col("router_status") != "not_used", F.concat(F.lit("status:"), "router_status"))
    keys = F.array_compact(F.array(F.concat(F.lit("mode:"), "retrieval_mode"), used))
    # Combined per pair first, so that only distinct pairs are exploded.
    pairs = (
        _retrieved(events, since, until)
        .groupBy("retrieval_mode", "router_status")
        .agg(F.count("*").alias("n"))
    )
    return (
        pairs.select(F.explode(keys).alias("key"), "n")
        .groupBy("key")
        .agg(F.sum("n").alias("count"))
    )
